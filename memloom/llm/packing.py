"""Best-fit packing of token sequences, improved by swap-based local search.

Only lengths decide how well pieces fit, and lengths are integers below the
capacity. So the whole corpus is packed as a histogram of at most ``capacity``
numbers: a bin is a pattern (a multiset of lengths) with a multiplicity, best fit
decreasing works on whole classes of equal bins, and local search exchanges
pieces between two patterns for as many bins as both have. What reaches the driver is
bounded by the capacity, whatever the corpus holds.

Local search on the underfull patterns makes one-for-one and two-for-one exchanges
and moves that raise the sum of squared fills, so that room gathers in few bins
until bins run empty.

Pieces then take the places of their length by number. Numbers come from counts
per (length, share) and a row number within each share; shares are hashes of the
piece, so a length that a third of all pieces has is still spread out.

Defined results: a null text is an empty one, whose sequence is the end token alone;
a text longer than the capacity is cut into full pieces, of which the first may
be shorter; repeated rows are packed each; other columns are ignored.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators.scratch import Scratch

from . import arrowtext as at
from .pretokens import spaced_pieces
from .transducer import byte_letters

CAPACITY = 1024
MEMO = 200_000
SHARE_ROWS = 20_000
Pattern = tuple[int, ...]


class Encoder:
    """Token ids of many texts at once; distinct pieces of a slice are merged once."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in back for c in token)}
        self.specials = [t["content"].encode() for t in spec["added_tokens"]]
        self.path, self.library = path, None
        pieces = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.merge = tiktoken.Encoding("pieces", pat_str=pieces, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.memo: dict[int, bytes] = {}

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice's texts, and where each text's ids begin (rows + 1 long)."""
        points, edges = at.code_points(data, offsets)
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts, ends = spaced_pieces(points, edges)
        hashes, where, back = np.unique(at.span_hashes(at.point_values(points), starts, ends), return_index=True, return_inverse=True)
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, merge, found, text = self.memo, self.merge, [], data.tobytes().decode("utf-8", "surrogatepass")
        for h, a, b in zip(hashes.tolist(), starts[where].tolist(), ends[where].tolist()):
            ids = memo.get(h)
            if ids is None:
                ids = memo[h] = np.array(merge(text[a:b]), np.uint32).tobytes()
            found.append(ids)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, begin = np.frombuffer(b"".join(found), np.uint32), np.cumsum(sizes) - sizes
        each = sizes[back]
        upto = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.arange(upto[-1]) - np.repeat(upto[:-1] - begin[back], each)]
        ids_first = upto[np.searchsorted(starts, edges)]
        raw = data.tobytes()
        if any(s in raw for s in self.specials):
            ids, ids_first = self._with_specials(raw, offsets, ids, ids_first)
        return ids, ids_first

    def _with_specials(self, raw: bytes, offsets: np.ndarray, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that hold a special token's string are encoded by the library as a whole."""
        if self.library is None:  # loaded where it is needed: it is large
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        out = []
        for k, (a, b) in enumerate(zip(offsets, offsets[1:])):
            text = raw[a:b]
            if any(s in text for s in self.specials):
                out.append(np.array(self.library.encode(text.decode("utf-8"), add_special_tokens=False).ids, np.uint32))
            else:
                out.append(ids[first[k] : first[k + 1]])
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length and ids (unsigned little-endian 32-bit numbers) of every piece of every document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder(tokenizer)
        for batch in batches:
            for low, high, data, offsets in at.slices(batch.column("text")):
                ids, first = machine.rows(data, offsets)
                if end_id is not None:
                    ids = np.insert(ids, first[1:], end_id)
                    first = first + np.arange(len(first))
                sizes = np.diff(first)
                counts = np.maximum(1, -(-sizes // capacity))
                row = np.repeat(np.arange(len(sizes)), counts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                head = (sizes - (counts - 1) * capacity)[row]
                start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                length = np.where(piece == 0, head, capacity)
                order = pa.array(low + row)
                bounds = np.append(4 * (first[:-1][row] + start), 4 * first[-1]).astype(np.int32)
                body = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(order), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), body],
                    ["id", "piece", "start", "length", "ids"],
                )

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return at.mapped(found, run, f"id {kind}, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


class Bins:
    """Bins as patterns with multiplicities, kept by fill."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.by_fill: dict[int, Counter[Pattern]] = {}
        self.fills: list[int] = []

    def add(self, pattern: Pattern, n: int) -> None:
        if not pattern or not n:
            return
        fill = sum(pattern)
        if fill not in self.by_fill:
            self.by_fill[fill] = Counter()
            insort(self.fills, fill)
        self.by_fill[fill][tuple(sorted(pattern, reverse=True))] += n

    def take(self, pattern: Pattern, n: int) -> None:
        fill = sum(pattern)
        held = self.by_fill[fill]
        held[pattern] -= n
        if not held[pattern]:
            del held[pattern]
        if not held:
            del self.by_fill[fill]
            self.fills.pop(bisect_left(self.fills, fill))

    def fullest(self, room: int) -> Pattern | None:
        """A pattern of the fullest bins that still have ``room``."""
        at_ = bisect_left(self.fills, self.capacity - room + 1) - 1
        return next(iter(self.by_fill[self.fills[at_]])) if at_ >= 0 else None

    def best_fit(self, histogram: dict[int, int]) -> None:
        for length in sorted(histogram, reverse=True):
            left = histogram[length]
            while left:
                pattern = self.fullest(length)
                if pattern is None:
                    per = self.capacity // length
                    if left >= per:
                        self.add((length,) * per, left // per)
                        left -= left // per * per
                    else:
                        self.add((length,) * left, 1)
                        left = 0
                    continue
                n = min(left, self.by_fill[sum(pattern)][pattern])
                self.take(pattern, n)
                self.add((*pattern, length), n)
                left -= n

    def total(self) -> int:
        return sum(n for held in self.by_fill.values() for n in held.values())

    def squared_fill(self) -> int:
        return sum(f * f * n for f, held in self.by_fill.items() for n in held.values())


def improving_exchange(a: Pattern, b: Pattern, capacity: int) -> tuple[Pattern, Pattern] | None:
    """The exchange between a fuller bin ``a`` and ``b`` that fills ``a`` most: a move, one for one, or two for one."""
    room, best, chosen = capacity - sum(a), 0, None
    gives: list[Pattern] = [(), *((x,) for x in sorted(set(a)))]
    takes: list[Pattern] = [*((x,) for x in sorted(set(b)))]
    takes += [(x, y) for i, x in enumerate(b) for y in b[i + 1 :]]
    for give in gives:
        for take in takes:
            gain = sum(take) - sum(give)
            if best < gain <= room:
                best, chosen = gain, (give, take)
        if best == room:
            break
    if chosen is None:
        return None
    left, right = Counter(a), Counter(b)
    left.subtract(chosen[0])
    left.update(chosen[1])
    right.subtract(chosen[1])
    right.update(chosen[0])
    return tuple(sorted(left.elements(), reverse=True)), tuple(sorted(right.elements(), reverse=True))


def wanted_sums(a: Pattern, capacity: int) -> int:
    """Bit s is set if ``a`` could take pieces of sum s in an exchange that fills it more."""
    room, bits = (1 << capacity - sum(a)) - 1, 0
    for give in {0, *a}:
        bits |= room << give + 1
    return bits


def offered_sums(b: Pattern) -> int:
    """Bit s is set if one or two pieces of ``b`` have the sum s."""
    bits = 0
    for i, x in enumerate(b):
        bits |= 1 << x
        for y in b[i + 1 :]:
            bits |= 1 << x + y
    return bits


def local_search(bins: Bins) -> int:
    """Exchange pieces between underfull bins until nothing raises the squared fill or no fewer bins can do; the number of exchanges.

    A pattern that is new or has become more frequent waits; it is tried with all underfull patterns, and leaves when
    none has an exchange with it. So when none waits, no two bins have one.
    """
    done, capacity, total = 0, bins.capacity, bins.total()
    least = -(-sum(f * n for f, held in bins.by_fill.items() for n in held.values()) // capacity)
    wanted: dict[Pattern, int] = {}
    offered: dict[Pattern, int] = {}
    waiting: list[tuple[int, Pattern]] = []

    def enter(pattern: Pattern) -> None:
        if pattern and sum(pattern) < capacity:
            if pattern not in wanted:
                wanted[pattern], offered[pattern] = wanted_sums(pattern, capacity), offered_sums(pattern)
            heappush(waiting, (sum(pattern), pattern))

    def held(pattern: Pattern) -> int:
        return bins.by_fill.get(sum(pattern), {}).get(pattern, 0)

    def partner(p: Pattern) -> tuple[Pattern, Pattern] | None:
        """The fullest underfull pattern that has an exchange with ``p``, as (fuller, emptier)."""
        fill, want, offer = sum(p), wanted[p], offered[p]
        for f in reversed(bins.fills):
            if f < capacity:
                for q, n in bins.by_fill[f].items():
                    if f >= fill and wanted[q] & offer and (q != p or n > 1):
                        return q, p
                    if f <= fill and want & offered[q] and (q != p or n > 1):
                        return p, q
        return None

    for f in bins.fills:
        if f < capacity:
            for p in bins.by_fill[f]:
                enter(p)
    while waiting and total > least:
        p = heappop(waiting)[1]
        while held(p) and total > least and (pair := partner(p)):
            a, b = pair
            new = improving_exchange(a, b, capacity)
            n = held(a) // 2 if a == b else min(held(a), held(b))
            bins.take(a, n)
            bins.take(b, n)
            for pattern in new:
                bins.add(pattern, n)
                enter(pattern)
                total -= n * (not pattern)
            for pattern in {a, b}:
                if not held(pattern):
                    wanted.pop(pattern, None), offered.pop(pattern, None)
            done += 1
    return done


def pack_lengths(histogram: dict[int, int], capacity: int = CAPACITY, search: bool = True) -> list[tuple[Pattern, int]]:
    """Patterns and how many sequences have each; together they hold every length as often as ``histogram`` says."""
    bins = Bins(capacity)
    bins.best_fit({k: n for k, n in histogram.items() if k < capacity})
    if search:
        local_search(bins)
    if full := histogram.get(capacity, 0):
        bins.add((capacity,), full)
    return [(p, n) for f in bins.fills for p, n in sorted(bins.by_fill[f].items())]


def assign_sequences(pieces: DataFrame, *, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "piece"), length_col: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset. ``pieces`` should be a written table: it is read several times."""
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy(length_col).agg(F.count(F.lit(1))).collect()}
    rows, sequence = [], 0
    taken: Counter[int] = Counter()
    for pattern, n in pack_lengths(histogram, capacity):
        offset = 0
        for length, times in ((x, 1) for x in pattern):
            rows.append((length, taken[length], taken[length] + n, sequence, offset))
            taken[length] += n * times
            offset += length
        sequence += n
    places = spark.createDataFrame(rows, "len long, low long, high long, first_sequence long, offset long")
    count = sum(histogram.values())
    shares = max(1, math.ceil(count / SHARE_ROWS))
    shared = pieces.withColumn("__share", F.pmod(F.xxhash64(*keys), F.lit(shares)))
    part = Window.partitionBy(length_col, "__share").orderBy(*keys)
    numbered = shared.withColumn("__number", F.row_number().over(part) - 1)
    counts = shared.groupBy(length_col, "__share").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(length_col).orderBy("__share").rowsBetween(Window.unboundedPreceding, -1)
    begin = counts.select(F.col(length_col).alias("__len"), F.col("__share").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__begin"))
    numbered = numbered.join(begin, (F.col(length_col) == F.col("__len")) & (F.col("__share") == F.col("__of"))).withColumn("__rank", F.col("__number") + F.col("__begin"))
    # A length's places are consecutive ranges of ranks, a row for each length. Written, so that its size is known: it is
    # broadcast if it is small enough, and else joined as a plain shuffle in which a hot length can be split.
    ranges = places.groupBy("len").agg(F.array_sort(F.collect_list(F.struct("low", "high", "first_sequence", "offset"))).alias("__places"))
    ranges = Scratch(spark, "pack").write(ranges.coalesce(1), "ranges")
    found = numbered.join(ranges, F.col(length_col) == F.col("len"))
    own = F.element_at(F.filter("__places", lambda p: (p["low"] <= F.col("__rank")) & (F.col("__rank") < p["high"])), 1)
    found = found.withColumn("__own", own)
    extra = [(F.col("__own.first_sequence") + F.col("__rank") - F.col("__own.low")).alias("sequence_id"), F.col("__own.offset").alias("offset")]
    return found.select(*pieces.columns, *extra)


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its checksum and its place: id, piece, start, length, ids_crc32, sequence_id, offset.

    The ids themselves come from ``token_pieces`` and join on (id, piece); they are not carried through the shuffle.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = token_pieces(docs, tokenizer, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col)
    pieces = scratch.write(pieces.select(id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return assign_sequences(pieces, capacity=capacity, keys=(id_col, "piece"))
