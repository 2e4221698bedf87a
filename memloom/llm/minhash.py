"""Near-duplicate detection with b-bit MinHash.

1. Every document gets its set of word shingles (64-bit hashes), ``MINIMA`` minima of
   it, band keys from the full minima and a packed signature of the low ``BITS`` bits of
   each minimum. Documents with equal sets become one representative.
2. Representatives that share a band key are candidates. Their similarity is
   estimated from the signatures by bit counts, corrected for chance agreement of the low bits;
   pairs more than four standard deviations below the threshold are dropped.
3. Estimated pairs are confirmed on the full shingle sets.

A bucket never yields its pairs as rows. First only its members against one hub are confirmed,
which makes most buckets one component. In what is left, members of different components are
compared by signature inside blocks of bounded size; members that have a partner above the cut are
marked, one row each. Marked members meet once more, now with their full sets, and each block
joins them by confirmed links and reports only links that joined something. A pair counts in the first band
that it shares. So every link between components is found, however large a bucket is. A bucket that still holds several components
sends each member to as many blocks as it has thousands (of ``BLOCK``) of members; other buckets send each once.

At a similarity of exactly 0.8 a pair shares no band with probability 3e-6, and its estimate lies below the cut with
probability 3e-5; with ``sigmas=None`` there is no cut and all candidates are confirmed.

Defined results: words are split at blanks after lower-casing A-Z; a text with fewer
words than a shingle has is one shingle; without words the set is empty and linked with
nothing; a row without an id is kept and has no component; extra columns are ignored by
``near_duplicates`` and kept by ``deduplicate``; rows repeating an id are one document with the longest of their texts,
and each has its result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators.components import connected_components
from memloom.operators.scratch import Scratch
from memloom.operators.skew import by_salt, salt_set, salted

from . import arrowtext as at

WORDS, PERCENT = 5, 80
BANDS, ROWS, BITS = 32, 5, 2
MINIMA = BANDS * ROWS
PLANE = -(-MINIMA // 64)
BLOCK, BLOCK_BYTES = 4096, 16 << 20
SIGMAS = 4.0
_SCALE, _SHIFT = at.odd_constants(MINIMA, 501), at.odd_constants(MINIMA, 502)
_BAND = at.odd_constants(ROWS, 503)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashed, first = at.hashed_words(data, offsets, at.BLANK_WORDS)
    grams, edges = at.gram_hashes(hashed, first, words)
    return [np.unique(grams[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def minima(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MINIMA minima of each set; sets are the stretches of ``grams`` that begin at ``starts`` (none empty)."""
    out = np.empty((len(starts), MINIMA), np.uint64)
    scratch = np.empty_like(grams)
    for k in range(MINIMA):
        np.multiply(grams, _SCALE[k], out=scratch)
        scratch += _SHIFT[k]
        out[:, k] = np.minimum.reduceat(scratch, starts)
    return at.mix64(out)


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(least), BANDS), np.uint64)
    for j in range(ROWS):
        keys += least[:, j::ROWS] * _BAND[j]
    return at.mix64(keys + np.arange(1, BANDS + 1, dtype=np.uint64))


def packed(least: np.ndarray) -> np.ndarray:
    """Low bits of the minima as BITS planes of PLANE 64-bit numbers each."""
    planes = []
    for bit in range(BITS):
        flags = ((least >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)
        flags = np.pad(flags, ((0, 0), (0, 64 * PLANE - MINIMA)))
        planes.append(np.packbits(flags, axis=1, bitorder="little").view(np.uint64))
    return np.concatenate(planes, axis=1)


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarities of one signature with many: share of equal fields, corrected for chance."""
    differ = np.zeros((len(many), PLANE), np.uint64)
    for bit in range(BITS):
        part = slice(bit * PLANE, (bit + 1) * PLANE)
        differ |= many[:, part] ^ one[part]
    agree = 1 - np.bitwise_count(differ).sum(1) / MINIMA
    chance = 0.5**BITS
    return (agree - chance) / (1 - chance)


def lowest_estimate(percent: int, sigmas: float | None = SIGMAS) -> float:
    if sigmas is None:
        return -math.inf
    chance = 0.5**BITS
    agree = percent / 100 * (1 - chance) + chance
    return percent / 100 - sigmas * float(np.sqrt(agree * (1 - agree) / MINIMA)) / (1 - chance)


def _sketcher(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in at.slices(batch.column("text")):
                sets = shingle_sets(data, offsets, words)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                signature, bands = [None] * len(sets), [None] * len(sets)
                digest = np.zeros((len(sets), 2), np.uint64)
                if len(full):
                    grams = np.concatenate([sets[i] for i in full])
                    starts = np.cumsum(sizes[full]) - sizes[full]
                    least = minima(grams, starts)
                    digest[full, 0] = np.add.reduceat(at.mix64(grams), starts)
                    digest[full, 1] = np.add.reduceat(at.mix64(grams ^ np.uint64(0x5851F42D4C957F2D)), starts)
                    marks, keys = packed(least), band_keys(least).view(np.int64)
                    for j, i in enumerate(full.tolist()):
                        signature[i], bands[i] = marks[j].tobytes(), keys[j]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(low, high - low), pa.array(sizes), pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)), pa.array(signature, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["id", "n", "d1", "d2", "signature", "bands"],
                )

    return run


def _set_maker(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in at.slices(batch.column("text")):
                sets = shingle_sets(data, offsets, words)
                edges = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(low, high - low), lists], ["id", "grams"])

    return run


class Block:
    """The rows of one bucket's block (or pair of blocks) that were sent together."""

    def __init__(self, parts: list[pa.RecordBatch], percent: int, sigmas: float | None = SIGMAS) -> None:
        table = pa.Table.from_batches(parts)
        self.key = table.column("key")[0].as_py()
        self.ids, self.comps, self.sizes = (table.column(c).to_numpy() for c in ("id", "comp", "n"))
        self.marks = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint64).reshape(len(table), -1)
        lists = {c: table.column(c).combine_chunks() for c in ("bands", "grams") if c in table.column_names}
        self.bands = lists["bands"].flatten().to_numpy().reshape(len(table), BANDS) if "bands" in lists else None
        if "grams" in lists:
            self.edges = np.concatenate([[0], np.cumsum(self.sizes)])
            # Sets are sorted as unsigned numbers, Spark has them signed.
            self.grams = lists["grams"].flatten().to_numpy().view(np.uint64)
        self.percent, self.cut = percent, lowest_estimate(percent, sigmas)

    def partners(self, i: int, comp: np.ndarray, at_least: int = 0) -> np.ndarray:
        """Rows from ``at_least`` on that may be similar to row i, are in another component, and meet it here first."""
        sizes = self.sizes
        other = at_least + np.flatnonzero((comp[at_least:] != comp[i]) & (100 * np.minimum(sizes[at_least:], sizes[i]) >= self.percent * np.maximum(sizes[at_least:], sizes[i])))
        if len(other):
            other = other[estimates(self.marks[i], self.marks[other]) >= self.cut]
        if len(other) and self.bands is not None:
            first = (self.bands[other] == self.bands[i]).argmax(1)
            other = other[self.bands[i, first] == self.key]
        return other

    def hub_pairs(self) -> list[tuple[int, ...]]:
        """(a, b) of the smallest id and what may be similar to it."""
        hub = int(self.ids.argmin())
        return [(int(self.ids[hub]), int(self.ids[j])) for j in self.partners(hub, self.comps) if self.ids[j] != self.ids[hub]]

    def marked(self) -> list[tuple[int, ...]]:
        """(key, id) of all rows that have a partner."""
        seen = np.zeros(len(self.ids), bool)
        for i in range(len(self.ids)):
            other = self.partners(i, self.comps, i + 1)
            if len(other):
                seen[i] = seen[other] = True
        return [(self.key, int(x)) for x in np.unique(self.ids[seen])]

    def links(self) -> list[tuple[int, ...]]:
        """(component, component) of confirmed links that joined something inside this block."""
        comp, out = self.comps.copy(), []
        for i in range(len(self.ids)):
            other = self.partners(i, comp, i + 1)
            if not len(other):
                continue
            own = self.grams[self.edges[i] : self.edges[i + 1]]
            rows = spread(self.edges[other], self.sizes[other])
            place = np.searchsorted(own, self.grams[rows])
            place[place == len(own)] = 0
            same = np.add.reduceat((own[place] == self.grams[rows]).astype(np.int64), np.cumsum(self.sizes[other]) - self.sizes[other])
            good = other[100 * same >= self.percent * (len(own) + self.sizes[other] - same)]
            for c in np.unique(comp[good]).tolist():
                if c != comp[i]:
                    out.append((int(min(c, comp[i])), int(max(c, comp[i]))))
                    comp[comp == c] = comp[i]
        return out


def spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... for counts[k] values each."""
    total = np.cumsum(counts)
    return np.arange(total[-1]) - np.repeat(total - counts, counts) + np.repeat(first, counts)


def _by_block(percent: int, method: str, names: list[str], sigmas: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (key, block); one block's rows are held at a time."""
        parts: list[pa.RecordBatch] = []
        at_ = None
        found: set[tuple[int, ...]] = set()

        def out() -> pa.RecordBatch:
            columns = list(zip(*found)) if found else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)

        for batch in batches:
            key, block = batch.column("key").to_numpy(), batch.column("block").to_numpy()
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1
            edges = [0, *cuts.tolist(), len(key)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                here = (int(key[a]), int(block[a]))
                if here != at_ and parts:
                    found.update(getattr(Block(parts, percent, sigmas), method)())
                    parts = []
                at_ = here
                parts.append(batch.slice(a, b - a))
            if len(found) > 50_000:
                yield out()
                found = set()
        if parts:
            found.update(getattr(Block(parts, percent, sigmas), method)())
        yield out()

    return run


def hub_pairs(members: DataFrame, percent: int, sigmas: float | None = SIGMAS) -> DataFrame:
    """(a, b): every block's smallest id with what may be similar to it. ``members``: key, count, id, comp, n, signature."""
    own = F.pmod(F.xxhash64("id"), F.ceil(F.col("count") / BLOCK).cast("int")).cast("long")
    rows = members.withColumn("block", own).select("key", "block", "id", "comp", "n", "signature")
    return at.mapped(rows.repartition("key", "block").sortWithinPartitions("key", "block"), _by_block(percent, "hub_pairs", ["a", "b"], sigmas), "a long, b long").distinct()


def _met(members: DataFrame, blocks, columns: list[str]) -> DataFrame:
    """Rows dealt so that each two blocks of a bucket meet once; ``blocks`` is the bucket's number of blocks."""
    dealt = members.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("block", F.least("own", "other").cast("long") * 1_000_000 + F.greatest("own", "other"))
    return dealt.select("key", "block", *columns).repartition("key", "block").sortWithinPartitions("key", "block")


def marked_members(members: DataFrame, percent: int, sigmas: float | None = SIGMAS) -> DataFrame:
    """(key, id) of members with a partner of another component. ``members``: key, count, id, comp, n, signature, bands."""
    rows = _met(members, F.ceil(F.col("count") / BLOCK), ["id", "comp", "n", "signature", "bands"])
    return at.mapped(rows, _by_block(percent, "marked", ["key", "id"], sigmas), "key long, id long").distinct()


def joining_links(members: DataFrame, percent: int, sigmas: float | None = SIGMAS) -> DataFrame:
    """(ca, cb): links between components, confirmed on full sets. ``members``: key, bytes, id, comp, n, signature, bands, grams."""
    rows = _met(members, F.ceil(F.col("bytes") / BLOCK_BYTES), ["id", "comp", "n", "signature", "bands", "grams"])
    return at.mapped(rows, _by_block(percent, "links", ["ca", "cb"], sigmas), "ca long, cb long").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    right = pairs.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    both = right.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a")
    same = F.size(F.array_intersect("ga", "gb"))
    return both.select("a", "b", same.alias("same"), (F.size("ga") + F.size("gb")).alias("sizes")).where(F.col("same") * 100 >= (F.col("sizes") - F.col("same")) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, sigmas: float | None = SIGMAS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable over links) and kept (the id itself) of every document; ids are integers."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if not texts.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        # One text for each id; rows without an id stay.
        own = texts.where("id is not null").groupBy("id").agg(F.max(F.struct(F.length("text"), "text"))["text"].alias("text"), F.count(F.lit(1)).alias("rows"))
        own = scratch.write(own, "texts")
        again = own.where("rows > 1").select("id", F.explode(F.sequence(F.lit(2), F.col("rows"))).alias("__copy")).select("id")
        texts = own.select("id", "text").unionByName(texts.where("id is null"))
    else:
        again = None
    sketches = scratch.write(at.mapped(texts, _sketcher(words), "id long, n long, d1 long, d2 long, signature binary, bands array<long>"), "sketches")
    rows = salted(sketches.select("id", "n", "d1", "d2"), "id")
    groups = scratch.write(rows.where("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("rep"), salt_set()), "groups")

    reps = sketches.join(groups.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    keyed = reps.select("id", F.explode("bands").alias("key"))
    # Written before they are joined: a join of two plain shuffles can be split where a key is hot.
    shared = scratch.write(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("count")).where("count > 1"), "shared")
    bucket = scratch.write(keyed.join(shared, "key"), "bucket")
    busy = scratch.write(bucket.select("id").distinct(), "busy")
    sketch = scratch.write(sketches.join(busy, "id", "left_semi").select("id", "n", "signature", "bands").dropDuplicates(["id"]), "sketch")
    sets = scratch.write(at.mapped(texts.join(busy, "id", "left_semi"), _set_maker(words), "id long, grams array<long>").dropDuplicates(["id"]), "sets")

    members = bucket.join(sketch.drop("bands"), "id").withColumn("comp", F.col("id"))
    pairs = scratch.write(hub_pairs(members, percent, sigmas), "pairs")
    links = scratch.write(confirmed(pairs, sets, percent), "hub-links")
    labels = connected_components(links, scratch=scratch, label="hub")
    joined = bucket.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", "count", F.coalesce("component", "id").alias("comp"))
    joined = scratch.write(joined, "joined")
    mixed = scratch.write(joined.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key"), "mixed")
    members = joined.join(mixed, "key").join(sketch, "id")
    marked = scratch.write(marked_members(members, percent, sigmas), "marked")
    sizes = scratch.write(marked.join(sketch.select("id", "n"), "id").groupBy("key").agg((F.sum("n") * 8).alias("bytes")), "sizes")
    meeting = marked.join(joined.select("key", "id", "comp"), ["key", "id"]).join(sizes, "key").join(sketch, "id").join(sets, "id")
    links = scratch.write(joining_links(meeting, percent, sigmas), "links")
    step = connected_components(links, a="ca", b="cb", scratch=scratch, label="all")
    moved = labels.join(step.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    labels = scratch.write(moved.unionByName(step.join(labels.select("node"), "node", "left_anti")), "labels")
    scratch.drop("shared", "bucket", "busy", "sketch", "sets", "pairs", "hub-links", "hub-labels", "joined", "mixed", "marked", "sizes", "links", "all-labels")

    ends = groups.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    ends = by_salt(ends.select("d1", "d2", "__salts", F.coalesce("component", "rep").alias("component_id")))
    known = rows.where("n > 0 and id is not null").join(ends, ["d1", "d2", "__salt"]).select("id", "n", "component_id")
    alone = rows.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    found = known.unionByName(alone)
    if again is not None:
        found = scratch.write(found, "found")
        found = found.unionByName(found.join(again, "id"))
    return found.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that stay, one of each component, with all their columns."""
    result = near_duplicates(docs, id_col=id_col, **options)
    gone = Scratch(docs.sparkSession, "near").write(result.where("not kept").select(F.col(id_col).alias("__gone")).distinct(), "gone")
    return docs.join(gone, docs[id_col].cast("long") == F.col("__gone"), "left_anti")
