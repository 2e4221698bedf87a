"""Token counts by a compiled finite-state tokenizer.

Texts are normalised and split as the vocabulary's file says, and every distinct
word of a slice is run once through the counting transducer (``transducer``);
counts are then added up per document. A text longer than ``CHUNK`` code points is
cut into chunks, inside a word where it must be, each chunk becomes a state map, and the maps are
composed by a scan; what is held for a chunk is numbers, so that memory does not grow with one text's words, nor with one word.

Map-side only: no shuffle, nothing gathered. A worker keeps its compiled states (bounded, see ``transducer``)
and a word memo of at most ``MEMO`` entries between batches; words are told apart
by 64-bit hashes. Each worker scans the chunks of its own texts.

Defined results: null and empty texts have no tokens; strings of special tokens in
a text count one token each; repeated rows are counted each; other columns are
ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .pretokens import LETTER, OTHER, SUFFIXES, classes, word_pieces
from .transducer import ChunkMap, CountingTransducer, Open, total_tokens

CHUNK = 1 << 18
MEMO = 500_000
SPECIALS = ("<|startoftext|>", "<|endoftext|>")
_special = re.compile("|".join(map(re.escape, SPECIALS)))


def normalise(text: str) -> str:
    """NFC and lower case of each character by itself (a final sigma is not treated specially)."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


class Counter:
    """Counts tokens of many texts at once; one per worker and vocabulary."""

    def __init__(self, path: str) -> None:
        self.machine = CountingTransducer(path)
        self.memo: dict[int, int] = {}

    def rows(self, texts: list[str]) -> np.ndarray:
        """Tokens of each normalised text."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not len(points):
            return np.zeros(len(texts), np.int64)
        starts, ends = word_pieces(points, offsets)
        hashes, where, back = np.unique(at.span_hashes(at.point_values(points), starts, ends), return_index=True, return_inverse=True)
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, counts = self.memo, np.empty(len(hashes), np.int64)
        for k, (h, a, b) in enumerate(zip(hashes.tolist(), starts[where].tolist(), ends[where].tolist())):
            n = memo.get(h)
            if n is None:
                n = memo[h] = self.machine.count(joined[a:b].encode("utf-8", "surrogatepass"))
            counts[k] = n
        total = np.concatenate([[0], np.cumsum(counts[back])])
        first = np.searchsorted(starts, offsets)
        return total[first[1:]] - total[first[:-1]]

    def cuts(self, points: np.ndarray, chunk: int) -> list[tuple[int, bool]]:
        """Ends of chunks of about ``chunk`` code points, and whether a word goes on there.

        A cut lies at a word's border or inside a run of letters or of other signs; never within reach of an apostrophe, whose rule looks ahead.
        """
        kind, n, out, at_ = classes()[points], len(points), [], 0
        longest = max(map(len, SUFFIXES)) + 1
        while n - at_ > chunk:
            cut = at_ + chunk
            while cut < n and (points[max(at_, cut - longest) : cut + 1] == 39).any():
                cut += 1
            if cut >= n:
                break
            out.append((cut, bool(kind[cut - 1] == kind[cut] and kind[cut] in (LETTER, OTHER))))
            at_ = cut
        out.append((n, False))
        return out

    def chunk_maps(self, text: str, chunk: int) -> list[ChunkMap]:
        """The state map of each chunk of a normalised text."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        maps, at_, goes_on = [], 0, False
        for cut, open_ in self.cuts(points, chunk):
            part = points[at_:cut]
            starts, ends = word_pieces(part, np.array([0, len(part)]))
            spell = lambda a, b: part[a:b].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")  # noqa: E731, B023
            first = int(ends[0]) if goes_on else 0
            if open_ and goes_on and len(starts) == 1:
                maps.append(ChunkMap(self.machine, spell(0, len(part)), False))
            else:
                last = int(starts[-1]) if open_ else len(part)
                inner = self.rows([part[first:last].tobytes().decode("utf-32-le", "surrogatepass")])[0] if last > first else 0
                after, more = Open(), 0
                if open_:
                    tail = spell(last, len(part))
                    state, more = self.machine.run(0, tail[:-1])
                    after = Open(self.machine.states[state], tail[-1])
                maps.append(ChunkMap(self.machine, spell(0, first), goes_on, int(inner) + more, after))
            at_, goes_on = cut, open_
        return maps

    def long(self, text: str, chunk: int) -> int:
        return total_tokens(self.chunk_maps(text, chunk))

    def column(self, column: pa.Array, chunk: int = CHUNK) -> np.ndarray:
        """Tokens of each text of an Arrow column."""
        out = []
        for first, end, data, offsets in at.slices(column):
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(offsets, offsets[1:])]
            extra = np.zeros(len(texts), np.int64)
            if b"<|" in raw:
                for i, t in enumerate(texts):
                    texts[i], extra[i] = _special.subn("\n", t)
            texts = [normalise(t) for t in texts]
            long = [i for i, t in enumerate(texts) if len(t) > chunk]
            counts = self.rows(["" if i in long else t for i, t in enumerate(texts)] if long else texts)
            for i in long:
                counts[i] = self.long(texts[i], chunk)
            out.append(counts + extra)
        return np.concatenate(out) if out else np.zeros(0, np.int64)


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(tokenizer)
        for batch in batches:
            counts = machine.column(batch.column("text"), chunk)
            _, offsets = at.utf8(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets), pa.int64()), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = at.mapped(found, run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
