"""Repeated passages by sparse suffixes.

Of all suffixes (by word) only those at minimisers are kept: in every window of
``min_words`` words the suffix whose first ``GRAM`` words hash lowest. Windows of equal
content choose the same suffix, so two documents that share a passage of
``min_words`` words share a kept suffix inside it.

1. Kept suffixes meet by the hash of their first words, and those that only one
   document has are dropped.
2. A kept suffix is responsible for a stretch of windows around it. Suffixes
   whose whole stretches agree need no further look: the match extends over all of it.
3. Where a suffix has stretches of different content, it is extended to the left and right window
   by window, one representative for each stretch that several documents share, and
   windows of equal content meet again.
4. Matches that touch are joined per document, so that spans are maximal.

Equal suffixes meet by hash aggregation, not by a global sort with a comparison of neighbours: the runs of equal keys
that the comparison would find are the same groups, and an aggregation is made in parts before the shuffle, so that a passage that a third of all documents
share is never one run in one task, which a sort by content would make of it.

The result is exact but for collisions of 64-bit hashes: a word is in a span if and only if it lies in ``min_words``
consecutive words that another document has too. Groups are aggregated before
each shuffle; results go back to the rows by salted joins; the text is read again only
where step 3 needs it.

Defined results: words are split at blanks after lower-casing A-Z; a null text or one
of fewer than ``min_words`` words has no spans; repeats within one document alone do not count;
rows that repeat an id are one document, whose text is the longest of them (of equally long ones the last in code point order); rows without an id and extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators.scratch import Scratch
from memloom.operators.skew import by_salt, salt_set, salted

from . import arrowtext as at

MIN_WORDS = 50
GRAM = 16


class Words:
    """The words of one slice: hashes, rows and places in code points."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        low = at.LOWER[data]
        self.starts, self.ends, self.first = at.runs(at.BLANK_WORDS[low], offsets)
        self.hashes = at.span_hashes(at.byte_values(low), self.starts, self.ends)
        self.points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.base = self.points[offsets]

    def place(self, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code-point offsets within the text of words start..end (numbers in the slice)."""
        return self.points[self.starts[start]] - self.base[row], self.points[self.ends[end - 1]] - self.base[row]


def minimiser_stretches(words: Words, min_words: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, minimiser, first and last window of each stretch (word numbers in the slice)."""
    n, none = len(words.hashes), np.zeros(0, np.int64)
    sizes = np.diff(words.first)
    count = np.maximum(0, sizes - min_words + 1)
    if not count.sum():
        return none, none, none, none
    row = np.repeat(np.arange(len(sizes)), count)
    window = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + words.first[row]
    every = np.arange(n - gram + 1)
    view = np.lib.stride_tricks.sliding_window_view(at.span_hashes(words.hashes, every, every + gram), min_words - gram + 1)
    chosen = np.empty(len(window), np.int64)
    for at_ in range(0, len(window), 1 << 15):
        part = window[at_ : at_ + (1 << 15)]
        chosen[at_ : at_ + len(part)] = part + view[part].argmin(1)
    new = np.ones(len(window), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(window)) - 1
    return row[head], chosen[head], window[head], window[last]


def _stretcher(min_words: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for low, high, data, offsets in at.slices(batch.column("text")):
                words = Words(data, offsets)
                row, chosen, first, last = minimiser_stretches(words, min_words, gram)
                if not len(row):
                    continue
                begin, end = words.place(row, first, last + min_words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[low + row]), pa.array((first - words.first[row]).astype(np.int32)), pa.array((last - words.first[row]).astype(np.int32)),
                     pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)),
                     pa.array(at.span_hashes(words.hashes, chosen, chosen + gram).view(np.int64)), pa.array(at.span_hashes(words.hashes, first, last + min_words).view(np.int64))],
                    ["id", "first", "last", "begin", "end", "gram", "stretch"],
                )

    return run


def _extender(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, todo = batch.column("id").to_numpy(), batch.column("todo")
            for low, high, data, offsets in at.slices(batch.column("text")):
                words = Words(data, offsets)
                lists = todo.slice(low, high - low)
                flat = lists.flatten()
                row = np.repeat(np.arange(high - low), np.asarray(pa.compute.list_value_length(lists)))
                first, last = flat.field("first").to_numpy(), flat.field("last").to_numpy()
                count = (last - first + 1).astype(np.int64)
                row = np.repeat(row, count)
                window = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count) + words.first[row]
                begin, end = words.place(row, window, window + min_words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at.span_hashes(words.hashes, window, window + min_words).view(np.int64)), pa.array(ids[low + row]),
                     pa.array((window - words.first[row]).astype(np.int32)), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)),
                     pa.array(np.repeat(flat.field("stretch").to_numpy(), count)), pa.array(np.repeat(flat.field("owner").to_numpy(), count)), pa.array(np.repeat(np.asarray(flat.field("many").to_numpy(zero_copy_only=False)), count))],
                    ["content", "id", "word", "begin", "end", "stretch", "owner", "many"],
                )

    return run


def repeated_spans(docs: DataFrame, *, min_words: int = MIN_WORDS, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per maximal repeated span: id, start_word, n_words, char_start, char_end, first_doc_id (the smallest that shares a part). Ids are integers."""
    scratch = Scratch(docs.sparkSession, "suffix")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    if _repeats(texts):
        texts = scratch.write(texts.groupBy("id").agg(F.max(F.struct(F.length("text"), "text"))["text"].alias("text")), "texts")
    suffixes = at.mapped(texts, _stretcher(min_words, gram), "id long, first int, last int, begin int, end int, gram long, stretch long")
    suffixes = scratch.write(suffixes, "suffixes")
    # Written, so that the join below reads two plain shuffles and a gram that many rows have can be split.
    shared = scratch.write(suffixes.groupBy("gram").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("gram"), "shared")
    kept = scratch.write(salted(suffixes.join(shared, "gram"), "id"), "kept")
    scratch.drop("suffixes", "shared")
    stretches = kept.groupBy("stretch").agg(F.first("gram").alias("gram"), F.min("id").alias("owner"), F.max("id").alias("high"), F.min(F.struct("id", "first", "last")).alias("one"), salt_set())
    stretches = scratch.write(stretches.withColumn("many", F.col("owner") < F.col("high")), "stretches")
    varied = scratch.write(stretches.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("gram"), "varied")
    open_ = scratch.write(stretches.join(varied, "gram").select("stretch", "owner", "many", "one", "__salts"), "open")

    look = open_.where("many").select("one.id", "one.first", "one.last", "stretch", "owner", "many")
    single = by_salt(open_.where("not many").select("stretch", "owner", "many", "__salts"))
    look = look.unionByName(kept.join(single, ["stretch", "__salt"]).select("id", "first", "last", "stretch", "owner", "many"))
    todo = look.groupBy("id").agg(F.collect_list(F.struct("first", "last", "stretch", "owner", "many")).alias("todo"))
    windows = texts.join(todo, "id")
    windows = at.mapped(windows.select("id", "text", "todo"), _extender(min_words), "content long, id long, word int, begin int, end int, stretch long, owner long, many boolean")
    windows = scratch.write(windows, "windows")
    found = windows.groupBy("content").agg(F.min("owner").alias("low"), F.max("owner").alias("high"), F.max("many").alias("any_many"), F.bit_or(F.expr("shiftleft(1L, cast(pmod(xxhash64(id), 64) as int))")).alias("__salts"))
    found = by_salt(found.where("low <> high or any_many").select("content", "low", "__salts"))
    hits = scratch.write(salted(windows, "id").join(found, ["content", "__salt"]).drop("__salt"), "hits")
    scratch.drop("varied", "open", "windows")

    earliest = hits.where("many").groupBy("stretch").agg(F.min("low").alias("low"))
    whole = stretches.where("many").join(earliest, "stretch", "left").select("stretch", F.coalesce("low", "owner").alias("low"), "__salts")
    spans = kept.join(by_salt(whole), ["stretch", "__salt"]).select("id", F.col("first").alias("start"), (F.col("last") + min_words).alias("stop"), "begin", "end", "low")
    spans = spans.unionByName(hits.where("not many").select("id", F.col("word").alias("start"), (F.col("word") + min_words).alias("stop"), "begin", "end", "low"))
    return _joined(spans).select(
        F.col("id").alias(id_col), F.col("start").cast("long").alias("start_word"), (F.col("stop") - F.col("start")).cast("long").alias("n_words"),
        F.col("begin").cast("long").alias("char_start"), F.col("end").cast("long").alias("char_end"), F.col("low").alias("first_doc_id"),
    )


def _repeats(texts: DataFrame) -> bool:
    return not texts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _joined(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of a document as one (a document's spans are bounded by its text)."""
    order = Window.partitionBy("id").orderBy("start", "stop")
    upto = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", F.when(F.col("start") <= upto, 0).otherwise(1))
    part = new.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy("id", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("low").alias("low"))


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with all their columns; passages that an earlier document shares are cut out of the text."""
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, **options).where(F.col("first_doc_id") < F.col(id_col))
    cuts = spans.groupBy(F.col(id_col).alias("__cut_id")).agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end"))).alias("__cuts"))
    both = docs.join(cuts, docs[id_col] == F.col("__cut_id"), "left")
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))
    step = lambda done, cut: F.struct(F.concat(done["text"], _part(text_col, done["at"], cut["char_start"])).alias("text"), cut["char_end"].alias("at"))
    rest = lambda done: F.concat(done["text"], _part(text_col, done["at"], F.lit((1 << 31) - 1)))
    text = F.when(F.col("__cuts").isNull(), F.col(text_col)).otherwise(F.aggregate(F.coalesce("__cuts", F.array().cast("array<struct<char_start:bigint,char_end:bigint>>")), start, step, rest))
    return both.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])


def _part(text_col: str, start, end):
    """Code points start..end (from 0, end exclusive) of the text."""
    return F.substring(F.col(text_col), (start + 1).cast("int"), (end - start).cast("int"))
