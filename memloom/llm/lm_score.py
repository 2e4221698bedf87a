"""Cross-entropy difference of documents under matched n-gram models over one shared vocabulary.

Tokens are the words of a text (or its bytes) and a mark at its end. The vocabulary is every token of the whole
corpus. Three models are counted on it: the target, on the documents whose label marks the wanted kind; the background, on
all others; and the corpus, on both. All have the same order and the same smoothing, an interpolation in which a shorter context
weighs as much as ``strength`` occurrences. Target and background are matched in size: counts of the larger one are scaled down to
the tokens of the smaller one, so the scores don't drift with the share of labels. No document is scored by a model that saw it: its
own counts are taken out first.

``score`` is the mean over tokens of target loss minus background loss, in bits: the lower it is, the more a document resembles
the target. ``corpus_loss`` is the loss under all other documents; a text that occurs elsewhere too has a small one.

How it is done: every n-gram of every document is counted, nothing is cut or sampled, and what is gathered grows with the input.

1. Rows are packed into blocks of about ``BLOCK_BYTES`` of text, one row each, and written.
2. A block's n-grams are sorted and counted, and go, in runs that share the top bits of their hash, to that run's bucket. There
   is a row for each block and bucket, so a word pair that every text has arrives once from each block, and a bucket holds about
   ``BUCKET_BYTES`` of text's n-grams at every size of the corpus, because there are more buckets then.
3. A bucket adds up its runs and answers each with what the other blocks have of its n-grams, in the run's own order; n-grams themselves do not travel back.
4. Blocks meet their answers and are scored, one block at a time.

Defined results: a null or empty text has no tokens and null losses and score; an id that is labelled several times counts as target
if any label does; without any target document, or any other one, both models are uniform and scores are zero; repeated rows are counted and scored each;
rows without an id are counted and scored as others are, but are never target; extra columns are ignored by ``scored`` and kept by ``select_like_target``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators.scratch import Scratch

from . import arrowtext as at

ORDER, STRENGTH = 2, 1.0
#: Text of a block and of a bucket. Larger ones mean fewer and longer runs (a corpus has blocks x buckets of them at most) and more memory of a task.
BLOCK_BYTES, BUCKET_BYTES = 2 << 20, 4 << 20
#: Target ids that are broadcast at most; more are joined by merge.
BROADCAST_IDS = 1 << 20
MARK = np.uint64(0x2545F4914F6CDD1D)
_PLACE = at.odd_constants(8, 601)
UNITS = ("word", "byte")


def tokens(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of each row, and the first of each row (rows + 1 long)."""
    if unit == "byte":
        return at.mix64(at.LOWER[data].astype(np.uint64) + np.uint64(1)), offsets
    return at.hashed_words(data, offsets, at.BLANK_WORDS)


def marked(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with a mark after each row that has any."""
    full = np.diff(first) > 0
    out = np.insert(words, first[1:][full], MARK)
    return out, first + np.concatenate([[0], np.cumsum(full)])


def gram_keys(words: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length up to ``order`` the n-gram that ends at each token; marks stand before a row. The lowest bit is free, the next one marks single tokens."""
    before = [words]
    begin = np.repeat(first[:-1], np.diff(first))
    place = np.arange(len(words))
    for back in range(1, order):
        shifted = np.full(len(words), MARK)
        inside = place - back >= begin
        shifted[inside] = words[place[inside] - back]
        before.append(shifted)
    keys, total = [], np.zeros(len(words), np.uint64)
    for k, part in enumerate(before):
        total = total + part * _PLACE[k]
        key = at.mix64(total + np.uint64(k + 1)) & ~np.uint64(3)
        keys.append(key | np.uint64(2) if k == 0 else key)
    return keys


def block_counts(keys: list[np.ndarray], target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of a block, how often each occurs, and how often in target rows (``target``: a flag for each token)."""
    flag = target.astype(np.uint64)
    every = np.sort(np.concatenate([k | flag for k in keys]))
    grams = every >> np.uint64(1)
    head = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    n = np.diff(np.append(head, len(grams)))
    wanted = np.add.reduceat((every & np.uint64(1)).astype(np.int64), head) if len(head) else n
    return grams[head], n, wanted


def planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all highest bytes together and so on: the empty ones compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def from_planes(raw: bytes, kind: type = np.uint64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: its rows as a compressed Arrow stream. Blocks are numbered by task, and hold from then on."""
    part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def out() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            for b in held:
                stream.write_batch(b)
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number]), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "size", "a"])

    for batch in batches:
        for low, high, data, _ in at.slices(batch.column("text"), BLOCK_BYTES // 2):
            if held and size + len(data) > BLOCK_BYTES:
                yield out()
                number, held, size = number + 1, [], 0
            held.append(batch.slice(low, high - low))
            size += len(data)
    if held:
        yield out()


def wanted_bytes(n: np.ndarray, wanted: np.ndarray) -> bytes:
    """Target counts beside counts: a bit where an n-gram occurs once, a number elsewhere."""
    one = n == 1
    return np.packbits(wanted[one].astype(np.uint8)).tobytes() + planes(wanted[~one].astype(np.uint32))


def from_wanted_bytes(raw: bytes, n: np.ndarray) -> np.ndarray:
    one = n == 1
    ones = int(one.sum())
    cut = -(-ones // 8)
    out = np.empty(len(n), np.uint32)
    out[one] = np.unpackbits(np.frombuffer(raw[:cut], np.uint8), count=ones)
    out[~one] = from_planes(raw[cut:], np.uint32)
    return out


class Block:
    """The rows of a block, their tokens and n-grams."""

    def __init__(self, raw: bytes, order: int, unit: str) -> None:
        table = pa.ipc.open_stream(pa.py_buffer(raw)).read_all().combine_chunks()
        self.ids = table.column("id").combine_chunks()
        self.target = np.asarray(table.column("target").to_numpy(), bool)
        # Slice by slice: hashing takes many times a text's bytes.
        parts = [tokens(data, offsets, unit) for _, _, data, offsets in at.slices(table.column("text").combine_chunks())]
        self.sizes = np.concatenate([np.diff(first) for _, first in parts])
        words, self.first = marked(np.concatenate([w for w, _ in parts]), np.concatenate([[0], np.cumsum(self.sizes)]))
        self.row = np.repeat(np.arange(len(self.sizes)), np.diff(self.first))
        self.keys = gram_keys(words, self.first, order)
        self.grams, self.n, self.wanted = block_counts(self.keys, self.target[self.row])


def _counter(order: int, unit: str, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per block and bucket: its n-grams as differences, and their counts."""
        for batch in batches:
            for number, raw in zip(batch.column("block").to_pylist(), batch.column("a")):
                block = Block(raw.as_py(), order, unit)
                edges = np.searchsorted(block.grams >> np.uint64(63 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                for bucket in np.flatnonzero(np.diff(edges)).tolist():
                    part = slice(edges[bucket], edges[bucket + 1])
                    grams = block.grams[part]
                    steps = np.concatenate([grams[:1], np.diff(grams)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([bucket], pa.int64()), pa.array([number]), pa.array([planes(steps)], pa.binary()), pa.array([planes(block.n[part].astype(np.uint32))], pa.binary()), pa.array([wanted_bytes(block.n[part], block.wanted[part])], pa.binary())],
                        ["bucket", "block", "grams", "n", "wanted"],
                    )

    return run


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict[str, object]]]:
    """Rows of one key after the other; they come sorted by it."""
    held: list[dict[str, object]] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != held[0][key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run how often its n-grams occur in other blocks, in the run's order; and a row for each bucket (block -1) with its single tokens: kinds, occurrences, those in the target."""
    names = ["block", "bucket", "a", "b"]
    for runs in _by_key(batches, "bucket"):
        bucket = runs[0]["bucket"]
        parts = [np.cumsum(from_planes(r.pop("grams"))) for r in runs]
        edges = np.cumsum([0, *map(len, parts)])
        grams, back = np.unique(np.concatenate(parts), return_inverse=True)
        own = [from_planes(r.pop("n"), np.uint32) for r in runs]
        own_wanted = [from_wanted_bytes(r.pop("wanted"), m) for r, m in zip(runs, own)]
        n = np.bincount(back, np.concatenate(own), len(grams)).astype(np.uint64)
        wanted = np.bincount(back, np.concatenate(own_wanted), len(grams)).astype(np.uint64)
        for r, a, b, m, t in zip(runs, edges, edges[1:], own, own_wanted):
            others, others_wanted = n[back[a:b]] - m, wanted[back[a:b]] - t
            yield pa.RecordBatch.from_arrays([pa.array([r["block"]]), pa.array([bucket]), pa.array([planes(others)], pa.binary()), pa.array([planes(others_wanted)], pa.binary())], names)
        single = (grams & np.uint64(1)).astype(bool)
        sums = np.array([single.sum(), n[single].sum(), wanted[single].sum()], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([bucket]), pa.array([sums.tobytes()], pa.binary()), pa.array([b""], pa.binary())], names)


class Totals:
    """Tokens of the corpus and the target, texts that have tokens, and the vocabulary's size."""

    def __init__(self, vocabulary: int, n: int, wanted: int, texts: int, wanted_texts: int) -> None:
        self.vocabulary, self.n, self.wanted, self.texts, self.wanted_texts = vocabulary, n, wanted, texts, wanted_texts


def block_losses(block: Block, n: np.ndarray, wanted: np.ndarray, all_: Totals, strength: float) -> np.ndarray:
    """Loss in bits of every row under target, background and corpus; ``n`` and ``wanted`` are the totals of the block's n-grams."""
    index = [np.searchsorted(block.grams, k >> np.uint64(1)) for k in block.keys]
    own = []
    for k in index:
        pair = block.row * np.int64(len(block.grams)) + k
        _, back, count = np.unique(pair, return_inverse=True, return_counts=True)
        own.append(count[back])
    full = np.flatnonzero(np.diff(block.first))
    head = block.first[:-1][full]
    length = np.diff(block.first)
    is_target = block.target[block.row]
    rest, rest_texts = all_.n - all_.wanted, all_.texts - all_.wanted_texts
    matched = min(all_.wanted, rest)
    out = np.zeros((3, len(length)))
    models = ((wanted, is_target, all_.wanted, all_.wanted_texts), (n - wanted, ~is_target, rest, rest_texts), (n, np.ones(len(block.row), bool), all_.n, all_.texts))
    for m, (counts, inside, size, texts) in enumerate(models):
        scale = 1.0 if m == 2 else matched / size if size else 0.0
        p = np.full(len(block.row), 1.0 / (all_.vocabulary + 1))
        context = (size - np.where(inside, length[block.row], 0)) * scale
        for k in range(len(index)):
            seen = (counts[index[k]].astype(np.float64) - np.where(inside, own[k], 0)) * scale
            p = (seen + strength * p) / (context + strength)
            # The next length's context is this n-gram one token earlier; before a row it is the mark, once for each text.
            context = np.concatenate([[0.0], seen[:-1]])
            context[head] = (texts - inside[head]) * scale
        out[m, full] = np.add.reduceat(-np.log2(p), head) if len(head) else 0
    return out


def _scorer(order: int, unit: str, all_: Totals, strength: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (block, bucket): a block's rows (bucket -1), then the answers of its buckets in order."""
        for rows in _by_key(batches, "block"):
            block = Block(rows[0]["a"], order, unit)
            n = block.n + np.concatenate([np.zeros(0, np.uint64), *[from_planes(r["a"]) for r in rows[1:]]]).astype(np.int64)
            wanted = block.wanted + np.concatenate([np.zeros(0, np.uint64), *[from_planes(r["b"]) for r in rows[1:]]]).astype(np.int64)
            losses = block_losses(block, n, wanted, all_, strength)
            yield pa.RecordBatch.from_arrays([block.ids, pa.array(block.sizes, pa.int64()), *map(pa.array, losses)], ["id", "n", "target", "background", "corpus"])

    return run


def flagged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, wanted: int) -> DataFrame:
    """(id, text, target) of every row."""
    target = labels.where(F.col(label_col) == wanted).select(F.col(id_col).alias("__id")).where("__id is not null").distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # Target ids are broadcast where their number is checked to be small; labels grow with the corpus, and then both sides are shuffled.
    few = target.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return texts.join(F.broadcast(target) if few else target.hint("merge"), F.col("id") == F.col("__id"), "left").select("id", "text", F.col("__id").isNotNull().alias("target"))


def scored(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", wanted: int = 1, order: int = ORDER, unit: str = "word", strength: float = STRENGTH) -> DataFrame:
    """id, n_tokens, target_loss, background_loss and corpus_loss (bits a token, the end of the text being one) and score of every row."""
    if unit not in UNITS or not 1 <= order <= len(_PLACE):
        raise ValueError(f"unit is one of {UNITS}, order is 1 to {len(_PLACE)}")
    scratch = Scratch(docs.sparkSession, "lm")
    rows = flagged(docs, labels, id_col, text_col, label_col, wanted)
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = scratch.write(at.mapped(rows, _packed, "block long, size long, a binary"), "blocks")
    size = blocks.agg(F.sum("size")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, size / BUCKET_BYTES))))
    runs = at.mapped(blocks.select("block", "a"), _counter(order, unit, bits), "bucket long, block long, grams binary, n binary, wanted binary")
    found = at.mapped(runs.repartition("bucket").sortWithinPartitions("bucket", "block"), _adder, "block long, bucket long, a binary, b binary")
    found = scratch.write(found, "found")
    sums = found.where("block = -1").select("a").toLocalIterator()
    vocabulary, n, target = (int(x) for x in sum((np.frombuffer(r.a, np.int64) for r in sums), np.zeros(3, np.int64)))
    texts = rows.where(_has_tokens("text", unit)).agg(F.count(F.lit(1)).alias("n"), F.count_if("target").alias("wanted")).first()
    both = blocks.select("block", F.lit(-1).cast("long").alias("bucket"), "a", F.lit(None).cast("binary").alias("b")).unionByName(found.where("block >= 0"))
    both = both.repartition("block").sortWithinPartitions("block", "bucket")
    scores = at.mapped(both, _scorer(order, unit, Totals(vocabulary, n, target, texts.n, texts.wanted), strength), f"id {kind}, n long, target double, background double, corpus double")
    mean = lambda c: F.when(F.col("n") > 0, c / (F.col("n") + 1))
    return scores.select(
        F.col("id").alias(id_col), F.col("n").alias("n_tokens"), mean(F.col("target")).alias("target_loss"), mean(F.col("background")).alias("background_loss"), mean(F.col("corpus")).alias("corpus_loss"),
        mean(F.col("target") - F.col("background")).alias("score"),
    )


def _has_tokens(text: str, unit: str):
    return F.col(text) != "" if unit == "byte" else F.col(text).rlike(r"[^\x20\x09-\x0D]")


def select_like_target(docs: DataFrame, labels: DataFrame, *, most: float = 0.0, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents whose score is at most ``most``, with all their columns; texts without tokens and rows without an id go."""
    good = scored(docs, labels, id_col=id_col, **options).where(F.col("score") <= most).select(F.col(id_col).alias("__good")).distinct()
    return docs.join(good, docs[id_col] == F.col("__good"), "left_semi")
