"""Benchmark decontamination with suffix arrays of the training text.

Documents stay where they are: each slice of a record batch is a shard with its
own suffix array over words, and every benchmark suffix (cut at the window
length) is binary-searched in it. The range it finds holds all verbatim
occurrences; occurrences of one item that follow each other at the same distance
are one longer match, so the longest match of each text and its place come out as
well. There is no shuffle, and a shard's memory is bounded by the slice.

A suffix can only begin a match if as many benchmark words follow each other as
the window has, so the arrays keep just those suffixes.

The benchmark is searched in parts of at most ``part_bytes`` of text (or one longer item), one after the other: a
part is gathered, broadcast (some 30 bytes for a byte of text in a worker), searched in all documents and destroyed. With one part, the usual case, the
documents are read once and nothing is written; with more, rows are numbered in a written copy, and each part adds only the rows that it hits.

Defined results: a null or word-less text has no words and no hits; an item
without words matches nothing; an item shorter than the window is one window of
its own length; items without an id are ignored, ids are of any type; repeated rows each get their own result; extra columns are
ignored by ``benchmark_matches`` and returned as they are by ``remove_contaminated``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from memloom.operators.scratch import Scratch

from . import arrowtext as at

WINDOW = 10
PART_BYTES = 2 << 20

class BenchmarkPart:
    """Windows of some benchmark items: sorted keys by window length, each with its (item, offset) pairs."""

    def __init__(self, items: list[tuple[object, str]], window: int) -> None:
        column = pa.array([t or "" for _, t in items], pa.large_string())
        data, offsets = at.utf8(column)
        words, first = at.hashed_words(data, offsets, at.PLAIN_WORDS)
        self.vocabulary = np.unique(words)
        ids = np.searchsorted(self.vocabulary, words).astype(np.uint32) + np.uint32(1)
        self.names = [i for i, _ in items]
        sizes = np.diff(first)
        self.groups = []
        for length in sorted(set(np.minimum(sizes[sizes > 0], window).tolist())):
            rows = np.flatnonzero(np.minimum(sizes, window) == length)
            starts = np.concatenate([np.arange(first[r], first[r + 1] - length + 1) for r in rows])
            owner = np.repeat(rows, sizes[rows] - length + 1)
            offset = starts - np.repeat(first[rows], sizes[rows] - length + 1)
            keys, back = np.unique(suffix_keys(ids, starts, length), return_inverse=True)
            order = np.argsort(back, kind="stable")
            begin = np.searchsorted(back[order], np.arange(len(keys) + 1))
            self.groups.append((length, keys, begin, owner[order], offset[order]))


def suffix_keys(ids: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The first ``depth`` word numbers of each suffix as bytes that sort like the words."""
    rows = ids[starts[:, None] + np.arange(depth)].astype(">u4")
    return np.ascontiguousarray(rows).view(f"S{4 * depth}").ravel()


def spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for counts[i] values each."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - counts, counts) + np.repeat(first, counts)


class Shard:
    """The words of one slice, their suffix array per window length, and the matches found in it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.words, self.first = at.hashed_words(data, offsets, at.PLAIN_WORDS)
        self.rows = len(offsets) - 1
        self.cover = np.zeros(len(self.words) + 1, np.int32)
        self.items: list[tuple[np.ndarray, np.ndarray]] = []
        self.names: list[object] = []
        self.longest = np.zeros(self.rows, np.int64)
        self.longest_at = np.full(self.rows, -1, np.int64)

    def search(self, part: BenchmarkPart) -> None:
        n = len(self.words)
        self.names = part.names
        if not n or not len(part.vocabulary):
            return
        ids = np.searchsorted(part.vocabulary, self.words)
        ids[ids == len(part.vocabulary)] = 0
        known = part.vocabulary[ids] == self.words
        places = np.arange(n)
        stop = np.minimum.accumulate(np.where(known, n, places)[::-1])[::-1]
        follow = np.minimum(stop, np.repeat(self.first[1:], np.diff(self.first))) - places
        ids = (ids + 1).astype(np.uint32)
        for length, keys, begin, owner, offset in part.groups:
            suffixes = np.flatnonzero(follow >= length)
            if not len(suffixes):
                continue
            sorted_keys = suffix_keys(ids, suffixes, length)
            array = np.argsort(sorted_keys, kind="stable")
            sorted_keys = sorted_keys[array]
            low, high = np.searchsorted(sorted_keys, keys, "left"), np.searchsorted(sorted_keys, keys, "right")
            found = np.flatnonzero(high > low)
            if not len(found):
                continue
            spots = suffixes[array[spread(low[found], (high - low)[found])]]
            np.add.at(self.cover, spots, 1)
            np.add.at(self.cover, spots + length, -1)
            window = np.repeat(found, (high - low)[found])
            owners = (begin[1:] - begin[:-1])[window]
            entry = spread(begin[window], owners)
            self._note(np.repeat(spots, owners), owner[entry], offset[entry], length)

    def _note(self, spot: np.ndarray, item: np.ndarray, offset: np.ndarray, length: int) -> None:
        """Remember (row, item) and join occurrences on one diagonal into longer matches."""
        row = np.searchsorted(self.first, spot, "right") - 1
        self.items.append((row, item))
        order = np.lexsort((spot, spot - offset, item, row))
        row, item, spot, offset = row[order], item[order], spot[order], offset[order]
        new = np.ones(len(spot), bool)
        new[1:] = (np.diff(row) != 0) | (np.diff(item) != 0) | (np.diff(spot - offset) != 0) | (np.diff(spot) != 1)
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(spot))) + length - 1
        for r, s, p in zip(row[head].tolist(), size.tolist(), spot[head].tolist()):
            if s > self.longest[r] or (s == self.longest[r] and p - self.first[r] < self.longest_at[r]):
                self.longest[r], self.longest_at[r] = s, p - self.first[r]

    def results(self) -> dict[str, object]:
        n_words = np.diff(self.first)
        hit = np.cumsum(self.cover[:-1]) > 0
        before = np.concatenate([[0], np.cumsum(hit)])
        n_hit = before[self.first[1:]] - before[self.first[:-1]]
        items: list[list[object]] = [[] for _ in range(self.rows)]
        if self.items:
            row, item = (np.concatenate(x) for x in zip(*self.items))
            for r, i in np.unique(np.stack([row, item]), axis=1).T.tolist():
                items[r].append(self.names[i])
        starts, ends, of = at.runs(hit, self.first)
        spans = [
            [{"start": int(s - self.first[r]), "length": int(e - s)} for s, e in zip(starts[of[r] : of[r + 1]], ends[of[r] : of[r + 1]])]
            for r in range(self.rows)
        ]
        return {"n_words": n_words, "n_hit": n_hit, "items": items, "hits": spans, "longest_words": self.longest, "longest_start": self.longest_at}


def benchmark_parts(benchmark: DataFrame, window: int, id_col: str, text_col: str, part_bytes: int) -> Iterator[BenchmarkPart]:
    """All items in parts of about ``part_bytes`` of text, one held at a time; there is at least one part."""
    items = benchmark.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).where("i is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = max(1, math.ceil(total / part_bytes))
    for k in range(count):
        rows = [(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i"), F.lit(count)) == k).orderBy("i").toLocalIterator()]
        if rows or count == 1:
            yield BenchmarkPart(rows, window)


def _search(docs: DataFrame, part, columns: list[str], item_type) -> DataFrame:
    """``columns`` and the matches of one part for every row; ``part`` is broadcast."""
    types = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(to_arrow_type(item_type)), "hits": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), "longest_words": pa.int64(), "longest_start": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in at.slices(batch.column("text")):
                shard = Shard(data, offsets)
                shard.search(part.value)
                out = shard.results()
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(low, high - low) for c in columns], *[pa.array(v, types[k]) for k, v in out.items()]], [*columns, *out])

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns]
    return at.mapped(docs, run, ", ".join([*kinds, f"n_words long, n_hit long, items array<{item_type.simpleString()}>, hits array<struct<start:long,length:long>>, longest_words long, longest_start long"]))


def joined_spans(spans: Column) -> Column:
    """Sorted spans, those that overlap or touch as one."""
    kind = "array<struct<start:bigint,length:bigint>>"

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        end = F.greatest(last["start"] + last["length"], s["start"] + s["length"])
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), (end - last["start"]).alias("length"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["start"] + F.try_element_at(done, F.lit(-1))["length"] >= s["start"]), longer).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document: words, hit words, matching items, hit spans (in words) and the longest match (0 words at -1 if there is none)."""
    context, item_type = docs.sparkSession.sparkContext, benchmark.schema[item_col].dataType
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = benchmark_parts(benchmark, window, item_col, item_text_col, part_bytes)
    part, following = next(parts), next(parts, None)
    if following is None:
        return _search(texts, context.broadcast(part), ["id"], item_type).withColumnRenamed("id", id_col)
    scratch = Scratch(docs.sparkSession, "benchmark")
    texts = scratch.write(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
    number, hit, every = 0, None, None
    while part is not None:
        shared = context.broadcast(part)
        found = _search(texts, shared, ["id", "row"], item_type)
        every = every or scratch.write(found.select("id", "row", "n_words"), "words")
        own = scratch.write(found.where("n_hit > 0").drop("id", "n_words", "n_hit"), f"part-{number}")
        hit = own if hit is None else hit.unionByName(own)
        shared.destroy()
        part, following, number = following, next(parts, None), number + 1
    best = F.max(F.struct("longest_words", (-F.col("longest_start")).alias("back")))
    merged = hit.groupBy("row").agg(F.flatten(F.collect_list("items")).alias("items"), joined_spans(F.flatten(F.collect_list("hits"))).alias("hits"), best.alias("best"))
    out = every.join(merged, "row", "left")
    n_hit = F.aggregate(F.coalesce("hits", F.array().cast("array<struct<start:bigint,length:bigint>>")), F.lit(0).cast("long"), lambda a, s: a + s["length"])
    return out.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.array_sort(F.coalesce("items", F.array().cast(f"array<{item_type.simpleString()}>"))).alias("items"),
        F.coalesce("hits", F.array().cast("array<struct<start:bigint,length:bigint>>")).alias("hits"), F.coalesce("best.longest_words", F.lit(0).cast("long")).alias("longest_words"), F.coalesce(-F.col("best.back"), F.lit(-1).cast("long")).alias("longest_start"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents without any hit, with all their columns. With several parts, what one part leaves is written and searched for the next."""
    context, scratch = docs.sparkSession.sparkContext, Scratch(docs.sparkSession, "benchmark")

    def clean(rows: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low, high, data, offsets in at.slices(batch.column(text_col)):
                    shard = Shard(data, offsets)
                    shard.search(shared.value)
                    yield batch.slice(low, high - low).filter(pa.array(shard.results()["n_hit"] == 0))

        return at.mapped(rows, run, docs.schema)

    parts = benchmark_parts(benchmark, window, item_col, item_text_col, part_bytes)
    part, following, number = next(parts), next(parts, None), 0
    while True:
        shared = context.broadcast(part)
        left = clean(docs, shared)
        if following is None:
            return left
        docs = scratch.write(left, f"left-{number}")
        shared.destroy()
        part, following, number = following, next(parts, None), number + 1
