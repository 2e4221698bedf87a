"""Secret scans: fixed patterns, and character Markov models for what they miss.

Patterns find assignments, access keys and long hex strings. In addition every
long run of credential characters that no pattern covers is scored by two Markov
models over characters, one of random strings and one of ordinary identifiers; it
is reported when the log-likelihood ratio favours random strings clearly.

Both models are trained from labelled samples: random strings are drawn by a
fixed rule from the alphabets that keys use and joined by what the patterns find in at
most ``SAMPLE_ROWS`` documents; ordinary identifiers are the other runs of those
documents, joined by compounds of plain words. The sample is the documents with
the smallest hash of their id.

Scanning is map-only. Bytes are searched for literals and classified by table, so
regular expressions run only where a literal was found.

Defined results: null and empty texts have no spans; spans are in code points of
the whole text, end exclusive; a random span never overlaps a pattern's; repeated
rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
LITERALS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = at.byte_table(b"0123456789abcdef")
CREDENTIAL = at.byte_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
LEAST = {"assign": 8, "access": 16, "hex": 32, "random": 16}
SAMPLE_ROWS = 4000
LEAST_RATIO, LEAST_PER_CHARACTER = 12.0, 0.6
#: Plain words that identifiers are made of.
WORDS = "get set user name list item value index count total file path data table row column key map node edge first last start end time date error message request response config default handler factory manager service client server session buffer stream reader writer parser format string number array object type class method return result status event update delete create insert select order group filter sort merge split window batch task worker thread process queue cache store load save open close read write send receive connect query page link image style width height color font text label button field form input output".split()


def literal_places(low: bytes) -> list[int]:
    places = []
    for literal in LITERALS:
        at_ = low.find(literal)
        while at_ >= 0:
            places.append(at_)
            at_ = low.find(literal, at_ + 1)
    return sorted(places)


def pattern_spans(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the slice for all pattern matches of its texts."""
    raw, low = data.tobytes(), at.LOWER[data].tobytes()
    out = []
    upto = -1
    for place in literal_places(low):
        if place < upto:
            continue
        end = int(offsets[np.searchsorted(offsets, place, "right")])
        if m := ASSIGN.match(raw, place, end):
            upto = m.end()
            if len(m[2]) >= LEAST["assign"]:
                out.append((place, 0, upto))
    if b"AKIA" in raw:
        at_ = 0
        while (at_ := raw.find(b"AKIA", at_)) >= 0:
            m = ACCESS.match(raw, at_, int(offsets[np.searchsorted(offsets, at_, "right")]))
            if m and m.end() - at_ >= LEAST["access"]:
                out.append((at_, 1, m.end()))
            at_ = m.end() if m else at_ + 4
    starts, ends, _ = at.runs(HEX[data], offsets)
    long = ends - starts >= LEAST["hex"]
    out += [(s, 2, e) for s, e in zip(starts[long].tolist(), ends[long].tolist())]
    return out


def open_runs(data: np.ndarray, offsets: np.ndarray, taken: list[tuple[int, int, int]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of credential characters of at least ``least`` bytes that no pattern span touches."""
    starts, ends, _ = at.runs(CREDENTIAL[data], offsets)
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    if taken and len(starts):
        cover = np.zeros(len(data) + 1, np.int32)
        for s, _, e in taken:
            cover[s] += 1
            cover[e] -= 1
        busy = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
        free = busy[ends] == busy[starts]
        starts, ends = starts[free], ends[free]
    return starts, ends


@dataclass(frozen=True)
class MarkovModels:
    """Log-likelihood ratio (random over ordinary) of each step from one byte to the next."""

    ratio: np.ndarray

    def score(self, run: bytes) -> float:
        codes = np.frombuffer(b"\0" + run, np.uint8)
        return float(self.ratio[codes[:-1], codes[1:]].sum())

    def is_random(self, run: bytes) -> bool:
        score = self.score(run)
        return score >= LEAST_RATIO and score >= LEAST_PER_CHARACTER * len(run)


def random_strings(n: int = 4000, seed: int = 20) -> list[bytes]:
    """Positive samples by rule: hex, base-32-like, base-62 and base-64 strings of 16 to 64 characters."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    alphabets = ["0123456789abcdef", letters.upper() + "0123456789", letters + letters.upper() + "0123456789", letters + letters.upper() + "0123456789+/", letters + "0123456789"]
    rng = np.random.default_rng(seed)
    return ["".join(np.array(list(alphabets[i % 5]))[rng.integers(0, len(alphabets[i % 5]), rng.integers(16, 65))]).encode() for i in range(n)]


def compounds(n: int = 4000, seed: int = 21) -> list[bytes]:
    """Negative samples by rule: snake_case, camelCase, kebab-case and path-like compounds, some with a number."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        parts = [WORDS[k] for k in rng.integers(0, len(WORDS), rng.integers(2, 6))]
        text = ("_".join(parts), parts[0] + "".join(p.title() for p in parts[1:]), "-".join(parts), "/".join(parts), "".join(p.title() for p in parts), "_".join(parts).upper())[i % 6]
        out.append((text + (str(rng.integers(0, 10000)) if i % 4 == 0 else "")).encode())
    return out


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, least: int = LEAST["random"]) -> MarkovModels:
    """Models from the rule-made samples and at most ``sample_rows`` documents; what is gathered is counts of byte pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in at.slices(batch.column("text")):
                raw, taken = data.tobytes(), pattern_spans(data, offsets)
                random = [raw[s:e] for s, k, e in taken if k] + [ASSIGN.match(raw, s, e)[2] for s, k, e in taken if not k]
                starts, ends = open_runs(data, offsets, taken, 8)
                ordinary = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
                pairs: dict[tuple[bool, int, int], int] = {}
                for label, runs in ((True, random), (False, ordinary)):
                    codes = np.frombuffer(b"\0".join([b"", *runs]), np.uint8).astype(np.int64)
                    kinds, n = np.unique(codes[:-1] * 256 + codes[1:], return_counts=True)
                    pairs |= {(label, int(k) >> 8, int(k) & 255): int(c) for k, c in zip(kinds, n)}
                if pairs:
                    label, a, b = zip(*pairs)
                    yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(list(pairs.values()), pa.int64())], ["random", "a", "b", "n"])

    ids = docs.select(F.col(id_col).alias("__id")).where("__id is not null").orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("text"))
    sample = texts.join(F.broadcast(ids.distinct()), F.col("__doc") == F.col("__id")).select("text")
    rows = at.mapped(sample, run, "random boolean, a int, b int, n long").groupBy("random", "a", "b").agg(F.sum("n").alias("n")).collect()
    tables = []
    for label, made in ((True, random_strings()), (False, compounds())):
        counts = np.zeros((256, 256))
        for r in rows:
            if r.random == label:
                counts[r.a, r.b] = r.n
        tables.append(step_logs(made, counts))
    return MarkovModels(tables[0] - tables[1])


def step_logs(sample: list[bytes], counts: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """Log probabilities of byte pairs in a sample and further counts; 0 stands before the first byte."""
    codes = np.frombuffer(b"\0".join([b"", *sample]), np.uint8)
    counts = counts.copy()
    np.add.at(counts, (codes[:-1], codes[1:]), 1)
    counts[:, ~CREDENTIAL] = 0
    back = np.where(CREDENTIAL, counts.sum(0) + 1.0, 0)
    back = back / back.sum()
    strength = smooth * 66
    with np.errstate(divide="ignore"):
        logs = np.log((counts + strength * back) / (counts.sum(1, keepdims=True) + strength))
    logs[~np.isfinite(logs)] = 0
    return logs


def scan(docs: DataFrame, models: MarkovModels | None, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST["random"]) -> DataFrame:
    """id and spans (kind, start, end in code points; by start, then kind) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans: list[list[dict[str, object]]] = []
            for _, _, data, offsets in at.slices(batch.column("text")):
                raw, found = data.tobytes(), pattern_spans(data, offsets)
                if shared.value is not None:
                    starts, ends = open_runs(data, offsets, found, least)
                    found += [(s, 3, e) for s, e in zip(starts.tolist(), ends.tolist()) if shared.value.is_random(raw[s:e])]
                rows: list[list[dict[str, object]]] = [[] for _ in range(len(offsets) - 1)]
                found.sort()
                # Code points up to each byte once for the slice, however many spans it has.
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if found else None
                owner = np.searchsorted(offsets, [s for s, _, _ in found], "right") - 1
                for row, (s, k, e) in zip(owner.tolist(), found):
                    start = int(points[s] - points[offsets[row]])
                    rows[row].append({"kind": KINDS[k], "start": start, "end": start + e - s})
                spans += rows
            if spans:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, pa.list_(span))], ["id", "spans"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return at.mapped(found, run, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("id", id_col)
