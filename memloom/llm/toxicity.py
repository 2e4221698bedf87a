"""A counterfactual-regularised toxicity classifier.

A logistic model over the presence of words and of word beginnings (so that inflected
and compounded forms are known by their stem) is fitted to labelled documents. In
every labelled text that mentions an identity term, the term is swapped for each
other term of its groups: all that the term brings into the text, its beginnings
included, goes, and all that the other brings comes. The squared change of the
text's score, averaged over the swaps, is part of the loss. A term that merely keeps
company with toxic texts then cannot carry a weight of its own, nor can its
beginnings, so neutral mentions of a group are not rejected.

Fitting uses at most ``max_rows`` labelled rows, those with the smallest hash of
their id, so the sample and everything gathered from it are bounded: candidates are counted
in Spark, those whose rates in the two classes differ by a log-likelihood ratio of ``LEAST_RATIO``, in
either direction and at any class rate, are kept, and rows reach the driver as lists of the few
kept features that they hold. Scoring reads every whole text once, without a shuffle.

Defined results: null and empty texts get the score of a text without any known
word; unlabelled, null-labelled and held-out rows are never learnt from; several
labels of one id count as their maximum; if the sample has no example of a class the score
is the smoothed share of toxic rows; repeated rows are scored each; extra columns are ignored by
``scored`` and kept by ``remove_toxic``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.operators.scratch import Scratch

from . import arrowtext as at

MAX_ROWS = 20_000
LEAST_RATIO, LEAST_ROWS = 16.0, 3
PENALTY, RIDGE = 100.0, 1e-4
THRESHOLD = 0.3
#: Groups of identity terms in four languages; terms of one group are swapped for each other.
IDENTITIES = (
    ("women", "men", "girls", "boys", "woman", "man"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners", "locals"),
    ("old", "young", "disabled", "deaf", "blind"),
    ("mujeres", "hombres", "niñas", "niños", "mujer", "hombre"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "latinos", "africanos", "europeos"),
    ("gais", "lesbianas", "heterosexuales", "bisexuales", "transexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "lugareños"),
    ("femmes", "hommes", "filles", "garçons", "femme", "homme"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "latinos", "africains", "européens"),
    ("gays", "lesbiennes", "hétérosexuels", "bisexuels", "transgenres"),
    ("immigrés", "réfugiés", "étrangers", "habitants"),
    ("frauen", "männer", "mädchen", "jungen", "frau", "mann"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "latinos", "afrikaner", "europäer"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle", "transgender"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
)


#: Lengths in bytes of the word beginnings that are features besides whole words.
STEMS = (4, 5, 6)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and their beginnings (a short word stands for its own), and the first of each row."""
    low = at.LOWER[data]
    starts, ends, first = at.runs(at.PLAIN_WORDS[low], offsets)
    values = at.byte_values(low)
    table = np.empty((len(starts), 1 + len(STEMS)), np.uint64)
    table[:, 0] = at.span_hashes(values, starts, ends)
    for j, size in enumerate(STEMS, 1):
        stem = at.span_hashes(values, starts, np.minimum(ends, starts + size)) ^ np.uint64(size)
        table[:, j] = np.where(ends - starts > size, stem, table[:, 0])
    return table.ravel(), first * (1 + len(STEMS))


@dataclass(frozen=True)
class Model:
    """Weights by word hash (sorted) and an intercept."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        found, first = features(data, offsets)
        total = np.full(len(offsets) - 1, self.bias)
        if len(self.words) and len(found):
            row, word = present(found, first, self.words)
            np.add.at(total, row, self.weights[word])
        return 1 / (1 + np.exp(-np.clip(total, -700, 700)))


def present(found: np.ndarray, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index into ``words``) of every known word, once for each row."""
    at_ = np.searchsorted(words, found)
    at_[at_ == len(words)] = 0
    known = np.flatnonzero(words[at_] == found)
    row = np.searchsorted(first, known, "right") - 1
    pairs = np.unique(row * len(words) + at_[known])
    return pairs // len(words), pairs % len(words)


def term_features(terms: list[str]) -> np.ndarray:
    """The features of single words, a row for each."""
    data, offsets = at.utf8(pa.array(terms, pa.string()))
    return features(data, offsets)[0].reshape(len(terms), 1 + len(STEMS))


class Swaps:
    """Identity terms, what may stand in their place, and which known features each brings."""

    def __init__(self, identities: tuple[tuple[str, ...], ...], words: np.ndarray | None = None) -> None:
        self.terms = sorted({t for group in identities for t in group})
        self.table = term_features(self.terms) if self.terms else np.zeros((0, 1 + len(STEMS)), np.uint64)
        number = {t: k for k, t in enumerate(self.terms)}
        self.partners = [sorted({number[b] for group in identities if t in group for b in group} - {number[t]}) for t in self.terms]
        self.by_hash = {int(h): k for k, h in enumerate(self.table[:, 0])}
        if words is not None:
            self.known = [set(np.searchsorted(words, row[np.isin(row, words)]).tolist()) for row in self.table]

    def copies(self, found: np.ndarray, words: np.ndarray) -> list[list[list[int]]]:
        """For each term that a text mentions, the known features of its copies with the term swapped. ``found``: the text's features, a row for each word."""
        mentioned = sorted({self.by_hash[h] for h in found[:, 0].tolist() if h in self.by_hash})
        out = []
        for k in mentioned:
            rest = found[found[:, 0] != self.table[k, 0]].ravel()
            place = np.searchsorted(words, rest)
            place[place == len(words)] = 0
            stays = set(place[words[place] == rest].tolist())
            if self.partners[k]:
                out.append([sorted(stays | self.known[b]) for b in self.partners[k]])
        return out


def share(id_: Column) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(4))


def held_out(id_: Column) -> Column:
    """The quarter of ids that is never learnt from; a null id is not held out."""
    return F.coalesce(share(id_) == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled texts (y, text); the label side is bounded and so broadcast."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("y"))
    own = one.where(~held_out(F.col("__id"))).orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(own), F.col("__doc") == F.col("__id")).select("y", "text")


def log_likelihood_ratio(toxic: Column, n: Column, all_toxic: int, all_n: int) -> Column:
    """Twice the log-likelihood ratio of a feature having a rate of its own in each class over one rate in both (large: it tells them apart)."""
    cells = ((toxic, n, all_toxic), (F.lit(all_toxic) - toxic, F.lit(all_n) - n, all_toxic), (n - toxic, n, all_n - all_toxic), (F.lit(all_n - all_toxic) - (n - toxic), F.lit(all_n) - n, all_n - all_toxic))
    total = F.lit(0.0)
    for seen, row, column in cells:
        total = total + F.when(seen > 0, 2 * seen * F.log(seen * F.lit(float(all_n)) / (row * F.lit(float(column))))).otherwise(0.0)
    return total


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, penalty: float = PENALTY, identities: tuple[tuple[str, ...], ...] = IDENTITIES) -> Model:
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, max_rows)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in at.slices(batch.column("text")):
                found, first = features(data, offsets)
                row = np.repeat(np.arange(high - low), np.diff(first))
                order = np.lexsort((found, row))
                row, found = row[order], found[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
                y = np.asarray(batch.column("y"))[low:high]
                words = np.concatenate([found[new].view(np.int64), np.zeros(high - low, np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.concatenate([y[row[new]], y]), pa.int32()), pa.array(np.concatenate([np.zeros(new.sum(), bool), np.ones(high - low, bool)]))], ["word", "y", "whole"])

    counts = at.mapped(sample, words_of, "word long, y int, whole boolean").groupBy("whole", "word").agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("n"))
    counts = Scratch(docs.sparkSession, "toxic").write(counts.where(F.col("whole") | (F.col("n") >= LEAST_ROWS)), "counts")
    totals = counts.where("whole").first()
    if totals is None or totals.toxic in (0, totals.n):
        toxic, n = (totals.toxic, totals.n) if totals else (0, 0)
        rate = (toxic + 1) / (n + 2)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(rate / (1 - rate))))
    chosen = counts.where("not whole").where(log_likelihood_ratio(F.col("toxic"), F.col("n"), totals.toxic, totals.n) >= LEAST_RATIO).select("word").toArrow().column("word").to_numpy()
    terms = Swaps(identities).table.ravel()
    words = np.unique(np.concatenate([chosen.astype(np.int64).view(np.uint64), terms]))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swaps = Swaps(identities, words)
        own = np.array(sorted(swaps.by_hash), np.uint64)
        for batch in batches:
            for low, high, data, offsets in at.slices(batch.column("text")):
                found, first = features(data, offsets)
                row, word = present(found, first, words)
                edges = np.searchsorted(row, np.arange(high - low + 1))
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(word, pa.int32()))
                table = found.reshape(-1, 1 + len(STEMS))
                copies: list[list[list[list[int]]]] = [[] for _ in range(high - low)]
                mentions = np.flatnonzero(np.isin(table[:, 0], own)) * (1 + len(STEMS))
                for r in np.unique(np.searchsorted(first, mentions, "right") - 1).tolist():
                    copies[r] = swaps.copies(found[first[r] : first[r + 1]].reshape(-1, 1 + len(STEMS)), words)
                kind = pa.list_(pa.list_(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(low, high - low), lists, pa.array(copies, kind)], ["y", "words", "copies"])

    rows = at.mapped(sample, known, "y int, words array<int>, copies array<array<array<int>>>").groupBy("y", "words", "copies").agg(F.count(F.lit(1)).alias("n")).orderBy("y", "words", "copies").collect()
    loss = Loss([r.words for r in rows], [float(bool(r.y)) for r in rows], [float(r.n) for r in rows], [r.copies for r in rows], len(words), penalty)
    weights = descend(loss)
    return Model(words, weights[:-1], float(weights[-1]))


class Loss:
    """Mean log loss, ridge, and ``penalty`` times the mean squared score change of swapped copies; sparse rows, one weight for each feature and a bias.

    ``copies``: of each row, for each mentioned term, the features of the copies; copies of one term share its weight.
    """

    def __init__(self, rows: list[list[int]], y: list[float], n: list[float], copies: list[list[list[list[int]]]], features: int, penalty: float, ridge: float = RIDGE) -> None:
        self.y, self.n, self.features, self.penalty, self.ridge = np.array(y), np.array(n), features, penalty, ridge
        self.row, self.col = self._flat(rows)
        made = [(i, c, 1 / len(term)) for i, terms in enumerate(copies) for term in terms for c in term]
        self.of = np.array([i for i, _, _ in made], np.int64)
        self.share = np.array([w for _, _, w in made]) * self.n[self.of] if made else np.zeros(0)
        self.copy_row, self.copy_col = self._flat([c for _, c, _ in made])

    @staticmethod
    def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = [len(x) for x in lists]
        return np.repeat(np.arange(len(lists)), sizes), np.array([v for x in lists for v in x], np.int64)

    def __call__(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """The loss and its slope."""
        total, bias = self.n.sum(), w[-1]
        z = np.bincount(self.row, w[self.col], len(self.y)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        value = (self.n * (np.logaddexp(0, z) - self.y * z)).sum() / total + self.ridge / 2 * (w[:-1] ** 2).sum()
        dz = self.n * (p - self.y) / total
        slope = np.append(self.ridge * w[:-1], 0.0)
        if len(self.of):
            q = np.bincount(self.copy_row, w[self.copy_col], len(self.of)) + bias
            q = 1 / (1 + np.exp(-np.clip(q, -500, 500)))
            change = p[self.of] - q
            value += self.penalty * (self.share * change**2).sum() / total
            pull = 2 * self.penalty * self.share * change / total
            dz += np.bincount(self.of, pull, len(z)) * p * (1 - p)
            dq = -pull * q * (1 - q)
            slope[:-1] += np.bincount(self.copy_col, dq[self.copy_row], self.features)
            slope[-1] += dq.sum()
        slope[:-1] += np.bincount(self.col, dz[self.row], self.features)
        slope[-1] += dz.sum()
        return float(value), slope


def descend(loss: Loss, steps: int = 300, keep: int = 12) -> np.ndarray:
    """Limited-memory quasi-Newton descent from zero, each step halved until the loss falls."""
    w = np.zeros(loss.features + 1)
    value, slope = loss(w)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, back = slope.copy(), []
        for s, g in reversed(moves):
            a = (s @ way) / (s @ g)
            back.append(a)
            way -= a * g
        if moves:
            s, g = moves[-1]
            way *= (s @ g) / (g @ g)
        for (s, g), a in zip(moves, reversed(back)):
            way += s * (a - (g @ way) / (s @ g))
        size = 1.0 if moves else 1 / max(1.0, np.abs(way).max())
        gain = slope @ way
        while True:
            new = w - size * way
            new_value, new_slope = loss(new)
            if new_value <= value - 1e-4 * size * gain or size < 1e-10:
                break
            size /= 2
        s, g = new - w, new_slope - slope
        done = size < 1e-10 or abs(value - new_value) < 1e-10
        w, value, slope = new, new_value, new_slope
        if done:
            break
        if s @ g > 1e-12:
            moves = [*moves[-keep + 1 :], (s, g)]
    return w


def scored(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted (score >= threshold) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [shared.value.scores(data, offsets) for _, _, data, offsets in at.slices(batch.column("text"))]
            if score:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(score))], ["id", "score"])

    found = at.mapped(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, f"id {kind}, score double")
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [shared.value.scores(data, offsets) < threshold for _, _, data, offsets in at.slices(batch.column(text_col))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return at.mapped(docs, run, docs.schema)
