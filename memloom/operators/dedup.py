"""Three layers of deduplication: artifacts, entities (exact and by vector), claims (with supersession), all reversible.

Groups are pre-aggregated on (key, item) before anything is collected per key, so a key that a third of all
rows has costs one task only its distinct items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom import schemas
from memloom.functions.text import artifact_key, claim_key, entity_key, fingerprint

from .components import connected_components
from .scratch import Scratch

PAIR_BLOCK = 2048


# ── artifacts ────────────────────────────────────────────────────────────────────────────────────────────────────
def artifact_groups(artifacts: DataFrame, *, id_col: str = "source_id", order_col: str = "seq", excerpt_col: str = "excerpt", length: int = 100) -> DataFrame:
    """``artifacts`` with canonical_id and canonical_order: the first artifact with the same opening. No row is dropped; blank openings stand alone."""
    keyed = artifacts.withColumn("artifact_key", artifact_key(F.col(excerpt_col), length))
    first = keyed.where("artifact_key <> ''").groupBy(F.col("artifact_key").alias("__k")).agg(F.min(F.struct(order_col, id_col)).alias("__f"), F.count(F.lit(1)).alias("__n"))
    out = keyed.join(first, F.col("artifact_key") == F.col("__k"), "left")
    return out.withColumns(
        {"canonical_id": F.coalesce(F.col(f"__f.{id_col}"), F.col(id_col)), "canonical_order": F.coalesce(F.col(f"__f.{order_col}"), F.col(order_col)), "group_size": F.coalesce("__n", F.lit(1).cast("long"))}
    ).drop("__k", "__f", "__n")


def resequenced(rows: DataFrame, groups: DataFrame, *, source_col: str = "source_id", order_col: str = "seq") -> DataFrame:
    """Rows with ``artifact_place`` (group's first artifact, own artifact): sorted by it, the rows of an artifact follow those of the first that opens alike."""
    names = groups.select(F.col("source_id").alias("__s"), "canonical_id", "canonical_order", F.col(order_col).alias("__own"))
    out = rows.join(names, rows[source_col] == F.col("__s"), "left")
    return out.withColumn("artifact_place", F.struct(F.col("canonical_order").alias("group"), F.col("__own").alias("own"))).drop("__s", "__own", "canonical_order")


# ── entities ─────────────────────────────────────────────────────────────────────────────────────────────────────
def exact_entities(entities: DataFrame) -> DataFrame:
    """One row per (type, name) key: the first entity with the others' aliases, names and seen-window folded in."""
    keyed = entities.withColumn("key", entity_key(F.col("type"), F.col("name")))
    seen = lambda c: F.nullif(F.col(c), F.lit(""))
    groups = keyed.groupBy("key").agg(
        F.min_by(F.struct("seq", "id", "name", "type", "aliases", "first_seen", "last_seen"), "seq").alias("w"),
        F.min(seen("first_seen")).alias("low"), F.max(seen("last_seen")).alias("high"), F.count(F.lit(1)).alias("members"),
    )
    own = groups.select("key", F.col("w.seq").alias("wseq"), F.col("w.name").alias("wname"))
    given = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name"))
    items = keyed.select("key", "seq", F.posexplode(given).alias("pos", "alias"), F.size(F.coalesce("aliases", F.array().cast("array<string>"))).alias("n"))
    items = items.join(own, "key").where("seq <> wseq and not (pos = n and alias = wname)")
    first = items.groupBy("key", "alias").agg(F.min(F.struct("seq", "pos")).alias("o"))
    lists = first.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("o", "alias"))).alias("more"))
    out = groups.join(lists, "key", "left")
    mine = F.coalesce("w.aliases", F.array().cast("array<string>"))
    extra = F.coalesce(F.transform("more", lambda m: m["alias"]), F.array().cast("array<string>"))
    return out.select(
        F.col("w.seq").alias("seq"), F.col("w.id").alias("id"), F.col("w.name").alias("name"), F.col("w.type").alias("type"),
        F.concat(mine, F.filter(extra, lambda a: ~F.array_contains(mine, a))).alias("aliases"),
        F.coalesce("low", "w.first_seen").alias("first_seen"), F.coalesce("high", "w.last_seen").alias("last_seen"), "members", "key",
    )


def exact_merges(entities: DataFrame) -> DataFrame:
    """Merge records of the exact pass; the winner's snapshot is its state before that very merge.

    An alias enters a snapshot where its key has it first, so a row carries only the aliases that it adds itself; the snapshot's list
    is a running concatenation of those, as long as the key has distinct names.
    """
    keyed = entities.withColumn("key", entity_key(F.col("type"), F.col("name")))
    none = F.array().cast("array<string>")
    given = keyed.select("key", "seq", F.posexplode(F.concat(F.coalesce("aliases", none), F.array("name"))).alias("pos", "alias"))
    first = given.groupBy("key", "alias").agg(F.min(F.struct("seq", "pos")).alias("at"))
    adds = first.groupBy("key", F.col("at.seq").alias("seq")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at.pos", "alias"))), lambda x: x["alias"]).alias("adds"))
    w = Window.partitionBy("key").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda c: F.nullif(F.col(c), F.lit(""))
    state = F.struct("id", "name", "type", "aliases", "first_seen", "last_seen")
    rows = keyed.join(adds, ["key", "seq"], "left").withColumns({
        "rn": F.row_number().over(w), "first": F.first(F.struct("id", "name", "type", "aliases", "first_seen", "last_seen")).over(w),
        "low": F.coalesce(F.min(seen("first_seen")).over(before), F.first("first_seen").over(w)), "high": F.coalesce(F.max(seen("last_seen")).over(before), F.first("last_seen").over(w)),
        "others": F.flatten(F.collect_list("adds").over(before)),  # collect_list leaves rows out that add nothing
    }).where("rn > 1")
    mine = F.coalesce("first.aliases", none)
    held = F.concat(mine, F.filter(F.coalesce("others", none), lambda a: ~F.array_contains(mine, a) & (a != F.col("first.name"))))
    winner = F.struct(F.col("first.id").alias("id"), F.col("first.name").alias("name"), F.col("first.type").alias("type"), held.alias("aliases"), F.col("low").alias("first_seen"), F.col("high").alias("last_seen"))
    return _record(rows, "entity", F.col("first.id"), F.col("id"), F.lit("exact_match"), winner, state, F.col("last_seen"))


def _record(rows: DataFrame, kind: str, winner_id: Column, loser_id: Column, reason: Column, winner: Column, loser: Column, ts: Column) -> DataFrame:
    return rows.select(
        schemas.stable_id(F.lit(kind), winner_id, loser_id, reason).alias("id"), F.lit(kind).alias("merge_type"), winner_id.alias("winner_id"), loser_id.alias("loser_id"),
        reason.alias("reason"), ts.cast("string").alias("timestamp"), F.lit(True).alias("reversible"),
        F.struct(F.to_json(winner).alias("winner"), F.to_json(loser).alias("loser")).alias("original_snapshots"),
    )


def _pair_blocks(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (type, cell); the two blocks of one cell are held at a time."""
        parts: list[pa.RecordBatch] = []
        at = None

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            seq = table.column("seq").to_numpy()
            mat = np.array(table.column("vec").to_pylist(), np.float64)
            side = np.asarray(table.column("side").to_pylist())
            left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            norms = np.sqrt((mat * mat).sum(1))
            sim = (mat[left] @ mat[right].T) / (norms[left][:, None] * norms[right][None, :] + 1e-9)
            i, j = np.nonzero(sim >= threshold)
            a, b, s = seq[left[i]], seq[right[j]], sim[i, j]
            one = side[left[i]] == 2
            keep = np.where(one, a < b, a != b)
            low, high = np.minimum(a, b)[keep], np.maximum(a, b)[keep]
            return pa.RecordBatch.from_arrays([pa.array([parts[0].column("type")[0].as_py()] * len(low), pa.string()), pa.array(low), pa.array(high), pa.array(s[keep])], ["type", "i", "j", "similarity"])

        for batch in batches:
            types, cells = batch.column("type").to_pylist(), batch.column("cell").to_pylist()
            start = 0
            for k in range(1, len(types) + 1):
                if k == len(types) or (types[k], cells[k]) != (types[start], cells[start]):
                    here = (types[start], cells[start])
                    if here != at and parts:
                        yield flush()
                        parts = []
                    at = here
                    parts.append(batch.slice(start, k - start))
                    start = k
        if parts:
            yield flush()

    return run


def cosine_pairs(vectors: DataFrame, threshold: float = schemas.SIMILARITY, *, block: int = PAIR_BLOCK) -> DataFrame:
    """(type, i, j, similarity) of all pairs of one type with i < j that reach the threshold.

    ``vectors``: seq, type, vec. All pairs of a type are compared, but in square cells of two blocks each, as
    matrix products; only pairs above the threshold leave a cell, and a cell's memory does not depend on the type's size.
    """
    sizes = vectors.groupBy("type").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = vectors.join(sizes, "type").withColumn("own", F.pmod(F.xxhash64("seq"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    cell = F.least("own", "other").cast("long") * 1_000_000 + F.greatest("own", "other")
    rows = dealt.select("type", cell.alias("cell"), side.alias("side"), "seq", F.col("vec").cast("array<double>").alias("vec"))
    return rows.repartition("type", "cell").sortWithinPartitions("type", "cell").mapInArrow(_pair_blocks(threshold), "type string, i long, j long, similarity double")


def _union_replay(pdf: pd.DataFrame) -> pd.DataFrame:
    """Ordered unions of one component (the left-hand root stays): which edges united, and every member's root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    united = []
    ordered = pdf.sort_values(["i", "j"])
    for i, j in ordered[["i", "j"]].itertuples(index=False):
        a, b = root(i), root(j)
        if a != b:
            parent[b] = a
        united.append(a != b)
    edges = ordered.assign(united=united, kind="edge", root=-1)[["kind", "i", "j", "similarity", "united", "root"]]
    nodes = pd.DataFrame({"kind": "node", "i": list(parent), "j": -1, "similarity": 0.0, "united": False})
    nodes["root"] = [root(n) for n in parent]
    return pd.concat([edges, nodes])


def union_order(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(member, root) and the edges that united, as an ordered union of all pairs would give; components are replayed apart."""
    parts = connected_components(pairs, a="i", b="j").select(F.col("node").alias("i"), "component")
    played = pairs.join(parts, "i").groupBy("component").applyInPandas(_union_replay, "kind string, i long, j long, similarity double, united boolean, root long")
    return played.where("kind = 'node'").select(F.col("i").alias("member"), "root"), played.where("kind = 'edge' and united").select("i", "j", "similarity")


def canonical_entities(entities: DataFrame, vec: Column, threshold: float = schemas.SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, id_remap, merge log): exact pass, then vectors within a type, then ordered unions.

    ``vec`` is an expression on name. As in the ordered procedure, a loser's name becomes an alias of the pair's left entity
    (which may not be the final root), and windows are not merged in the vector pass.
    """
    scratch = Scratch(entities.sparkSession, "entities")
    exact = scratch.write(exact_entities(entities), "exact")
    pairs = scratch.write(cosine_pairs(scratch.write(exact.select("seq", "type", vec.alias("vec")), "vectors"), threshold), "pairs")
    roots, united = union_order(pairs)
    roots, united = scratch.write(roots, "roots"), scratch.write(united, "united")
    name = exact.select("seq", "id", "name", "type", "aliases", "first_seen", "last_seen")
    l, r = name.select([F.col(c).alias(f"l_{c}") for c in name.columns]), name.select([F.col(c).alias(f"r_{c}") for c in name.columns])  # noqa: E741
    both = united.join(l, F.col("i") == F.col("l_seq")).join(r, F.col("j") == F.col("r_seq"))
    added = both.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "r_name"))), lambda x: x["r_name"]).alias("names"))
    final = exact.join(roots, exact["seq"] == F.col("member"), "left").where(F.col("root").isNull() | (F.col("root") == F.col("seq")))
    final = final.join(added, final["seq"] == F.col("i"), "left")
    fresh = F.filter(F.array_distinct(F.coalesce("names", F.array().cast("array<string>"))), lambda a: ~F.array_contains("aliases", a))
    final = final.withColumn("aliases", F.concat("aliases", fresh)).drop("member", "root", "i", "names")
    to = exact.select("key", F.col("seq").alias("wseq")).join(roots, F.col("wseq") == F.col("member"), "left").select("key", F.coalesce("root", "wseq").alias("rseq"))
    to = to.join(exact.select(F.col("seq").alias("rseq"), F.col("id").alias("root_id")), "rseq")
    remap = entities.select(F.col("id"), entity_key(F.col("type"), F.col("name")).alias("key")).join(to, "key").select("id", "root_id")
    snap = lambda p: F.struct(*[F.col(f"{p}_{c}").alias(c) for c in ("id", "name", "type", "aliases", "first_seen", "last_seen")])
    log = _record(both, "entity", F.col("l_id"), F.col("r_id"), F.format_string("semantic_similarity=%.3f", "similarity"), snap("l"), snap("r"), F.col("r_last_seen"))
    return final, remap, exact_merges(entities).unionByName(log)


# ── claims ───────────────────────────────────────────────────────────────────────────────────────────────────────
def remapped(claims: DataFrame, remap: DataFrame) -> DataFrame:
    """Subject and object ids replaced by their canonical ids; names stay."""
    s, o = remap.select(F.col("id").alias("__s"), F.col("root_id").alias("__sr")), remap.select(F.col("id").alias("__o"), F.col("root_id").alias("__or"))
    out = claims.join(s, claims["subject_id"] == F.col("__s"), "left").join(o, F.col("object_id") == F.col("__o"), "left")
    return out.withColumns({"subject_id": F.coalesce("__sr", "subject_id"), "object_id": F.coalesce("__or", "object_id")}).drop("__s", "__sr", "__o", "__or")


def merged_claims(claims: DataFrame) -> DataFrame:
    """One claim per (subject name, relation, object name): the latest, with the highest confidence and all novel evidence, and ``occurrences``.

    Evidence: the winner's own as it is, then what the older claims add, oldest first, one per fingerprint.
    """
    keyed = claims.withColumn("key", claim_key(F.col("subject_name"), F.col("relation"), F.col("object_name")))
    when = F.coalesce("valid_from", F.lit(""))
    wins = keyed.groupBy("key").agg(F.max_by(F.struct(*[c for c in claims.columns if c != "evidence"]), F.struct(when, F.col("seq"))).alias("w"), F.max("confidence").alias("top"), F.count(F.lit(1)).alias("occurrences"))
    wins = wins.withColumn("wseq", F.col("w.seq"))
    items = keyed.select("key", "seq", when.alias("at"), F.posexplode("evidence").alias("pos", "e")).withColumn("fp", fingerprint(F.col("e.source_id"), F.col("e.excerpt")))
    items = items.join(wins.select("key", "wseq"), "key").withColumn("own", F.col("seq") == F.col("wseq"))
    own = items.where("own").groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fp", "e"))), lambda x: F.struct(x["fp"].alias("fp"), x["e"].alias("e"))).alias("mine"))
    new = items.where("not own").groupBy("key", "fp").agg(F.min_by("e", F.struct("at", "seq", "pos")).alias("e"), F.min(F.struct("at", "seq", "pos")).alias("o"))
    new = new.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "fp", "e"))), lambda x: F.struct(x["fp"].alias("fp"), x["e"].alias("e"))).alias("others"))
    out = wins.join(own, "key", "left").join(new, "key", "left")
    kind = f"array<struct<fp:string,e:{schemas.EVIDENCE}>>"
    mine, others = F.coalesce("mine", F.array().cast(kind)), F.coalesce("others", F.array().cast(kind))
    fps = F.transform(mine, lambda x: x["fp"])
    evidence = F.concat(F.transform(mine, lambda x: x["e"]), F.transform(F.filter(others, lambda x: ~F.array_contains(fps, x["fp"])), lambda x: x["e"]))
    plain = [F.col(f"w.{c}").alias(c) for c in claims.columns if c not in ("evidence", "confidence")]
    return out.select(*plain, F.col("top").alias("confidence"), evidence.alias("evidence"), "occurrences", "key")


def claim_merges(claims: DataFrame) -> DataFrame:
    """Merge records of the claim pass, oldest first; the winner's snapshot has the confidence reached before that merge.

    The winner comes from an aggregation, made in parts before the shuffle, and the confidence from a running maximum, so no task holds a key's rows at once.
    """
    keyed = claims.withColumn("key", claim_key(F.col("subject_name"), F.col("relation"), F.col("object_name")))
    when = F.coalesce("valid_from", F.lit(""))
    wins = keyed.groupBy("key").agg(F.max_by(F.struct(*claims.columns), F.struct(when, "seq")).alias("win"), F.count(F.lit(1)).alias("n")).where("n > 1")
    before = Window.partitionBy("key").orderBy(when, "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = keyed.withColumn("upto", F.max("confidence").over(before)).join(wins, "key").where(F.col("seq") != F.col("win.seq"))
    names = [c for c in claims.columns if c != "evidence"]
    winner = F.struct(*[F.greatest(F.col("win.confidence"), F.col("upto")).alias(c) if c == "confidence" else F.col(f"win.{c}").alias(c) for c in names], F.col("win.evidence").alias("evidence"))
    reason = F.concat(F.lit("same_canonical_key ("), F.col("n").cast("string"), F.lit(" occurrences)"))
    return _record(rows, "claim", F.col("win.id"), F.col("id"), reason, winner, F.struct(*claims.columns), F.col("valid_from"))


def superseded(claims: DataFrame, relations: tuple[str, ...] = ("has_status", "has_role")) -> DataFrame:
    """Claims whose object differs from the subject's next one become historical until then.

    A lead over (subject, time): one shuffle on the subject. A subject's claims are its history, not a cross product.
    """
    own = F.col("relation").isin(*relations)
    w = Window.partitionBy("subject_id", F.when(own, 0).otherwise(F.col("seq"))).orderBy(F.coalesce("valid_from", F.lit("")), "seq")
    nxt = F.when(own, F.lead(F.struct("id", "object_name", "valid_from")).over(w))
    out = claims.withColumn("__next", nxt)
    over = F.col("__next").isNotNull() & (F.col("__next.object_name") != F.col("object_name"))
    return out.withColumns({
        "status": F.when(over, "historical").otherwise(F.col("status")), "valid_until": F.when(over, F.col("__next.valid_from")).otherwise(F.col("valid_until")),
        "superseded_by": F.when(over, F.col("__next.id")).otherwise(F.col("superseded_by")),
    }).drop("__next")


def supersessions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Merge records of superseded claims."""
    old = after.where("status = 'historical' and superseded_by is not null").select(F.col("id").alias("old_id"), F.col("superseded_by").alias("new_id"))
    a = before.select(F.col("id").alias("old_id"), F.struct(*before.columns).alias("old"))
    b = before.select(F.col("id").alias("new_id"), F.struct(*before.columns).alias("new"))
    rows = old.join(a, "old_id").join(b, "new_id")
    reason = F.concat(F.lit("temporal_supersede: '"), "old.object_name", F.lit("' → '"), "new.object_name", F.lit("'"))
    return _record(rows, "claim", F.col("new_id"), F.col("old_id"), reason, F.col("new"), F.col("old"), F.col("new.valid_from"))


def confident(claims: DataFrame, least: float = schemas.CONFIDENCE) -> DataFrame:
    return claims.where(F.col("confidence") >= least)


def referenced(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """Entities that a claim mentions; the ends are distinct before the semi join."""
    ends = claims.select(F.explode(F.array("subject_id", "object_id")).alias("id")).distinct()
    return entities.join(ends, "id", "left_semi")


def orphans(entities: DataFrame, claims: DataFrame) -> DataFrame:
    ends = claims.select(F.explode(F.array("subject_id", "object_id")).alias("id")).distinct()
    return entities.join(ends, "id", "left_anti")


class Deduplicator:
    """All layers in order, chained: ``Deduplicator(entities, claims, embed).run_full_pipeline().to_memory_store()``.

    With ``artifacts`` (source_id, seq, excerpt) the rows carry thread_id and ``place`` instead of ``seq``: rows of artifacts that open
    alike follow the first one's, and that order decides which entity and claim wins. Nothing is dropped by it.
    """

    def __init__(self, entities: DataFrame, claims: DataFrame, embed, *, artifacts: DataFrame | None = None, similarity: float = schemas.SIMILARITY, confidence: float = schemas.CONFIDENCE) -> None:
        self.entities, self.claims, self.embed, self.artifacts = entities, claims, embed, artifacts
        self.similarity, self.confidence = similarity, confidence
        self.merge_log: DataFrame | None = None
        self.id_remap: DataFrame | None = None
        self.scratch = Scratch(entities.sparkSession, "dedup")

    def _in_artifact_order(self, rows: DataFrame, groups: DataFrame, name: str) -> DataFrame:
        placed = resequenced(rows, groups, source_col="thread_id").orderBy("artifact_place", "place", "id")
        # Written: the numbers follow the sort and must not change between two readings.
        return self.scratch.write(placed.withColumn("seq", F.monotonically_increasing_id()).drop("artifact_place", "canonical_id", "place", "thread_id"), name)

    def run_full_pipeline(self) -> Deduplicator:
        entities, claims = self.entities, self.claims
        if self.artifacts is not None:
            groups = self.scratch.write(artifact_groups(self.artifacts), "artifacts")
            entities, claims = self._in_artifact_order(entities, groups, "entities"), self._in_artifact_order(claims, groups, "claims")
        self.entities, self.id_remap, log = canonical_entities(entities, self.embed(F.col("name")), self.similarity)
        # Each layer is read several times by the next ones and by the log, so it is written.
        self.entities, self.id_remap = self.scratch.write(self.entities, "canonical"), self.scratch.write(self.id_remap, "remap")
        moved = self.scratch.write(remapped(claims, self.id_remap), "moved")
        merged = self.scratch.write(merged_claims(moved).drop("occurrences", "key"), "merged")
        done = self.scratch.write(superseded(merged), "superseded")
        self.claims = confident(done, self.confidence)
        self.merge_log = log.unionByName(claim_merges(moved)).unionByName(supersessions(merged, done))
        self.entities = referenced(self.entities.drop("members", "key"), self.claims)
        return self

    def to_memory_store(self):
        from memloom.store import MemoryStore

        return MemoryStore(self.entities, self.claims, self.merge_log)

    def save(self, path: str) -> str:
        for name, df in (("entities", self.entities), ("claims", self.claims), ("merge_log", self.merge_log), ("id_remap", self.id_remap)):
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        return path
