"""Property multigraph as node and edge tables, its statistics and exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom import schemas
from memloom.functions.text import percent

from .components import connected_components
from .scratch import Scratch


EDGE_KEY = ("subject_id", "object_id", "id")


def ends(claims: DataFrame) -> DataFrame:
    """(id, name, seq, side) of both ends of every claim."""
    return claims.select(F.col("seq"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("subject_id").alias("id"), F.col("subject_name").alias("name")), F.struct(F.lit(1).alias("side"), F.col("object_id").alias("id"), F.col("object_name").alias("name")))).alias("e")).select("seq", "e.*")


def stub_nodes(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """(id, name, type) of claim ends that are no entity; the first claim gives the name."""
    first = ends(claims).groupBy("id").agg(F.min(F.struct("seq", "side", "name")).alias("f")).select("id", F.col("f.name").alias("name"))
    return first.join(entities.select("id"), "id", "left_anti").withColumn("type", F.lit(schemas.UNKNOWN))


def build_graph(entities: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): entities and stubs; one edge per (subject, object, claim id), the last row winning."""
    nodes = entities.select("id", "name", "type").unionByName(stub_nodes(entities, claims))
    return nodes, last_edges(claims)


def last_edges(claims: DataFrame) -> DataFrame:
    """One edge per (subject, object, claim id), the last row winning. Only ids repeat in a log of upserts, so a column that is not read is not carried."""
    rest = [c for c in claims.columns if c not in EDGE_KEY]
    last = claims.groupBy(*EDGE_KEY).agg(*[F.max_by(c, "seq").alias(c) for c in rest])
    return last.select(*claims.columns)


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """In plus out; a self-loop counts twice. Partial counts leave each task, not edges."""
    return edges.select(F.explode(F.array("subject_id", "object_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def top_degree(nodes: DataFrame, edges: DataFrame, k: int = 15) -> DataFrame:
    best = degrees(edges).orderBy(F.col("degree").desc(), "id").limit(k)
    return nodes.join(F.broadcast(best), "id").select("id", "name", "type", "degree")


def coverage(edges: DataFrame) -> DataFrame:
    """One row: claims, evidence, claims with evidence and their share as text."""
    size = F.coalesce(F.size("evidence"), F.lit(0))
    out = edges.agg(F.count(F.lit(1)).alias("claims"), F.coalesce(F.sum(F.greatest(size, F.lit(0))), F.lit(0)).alias("evidence"), F.count_if(size > 0).alias("grounded"))
    return out.withColumn("coverage", percent(F.col("grounded"), F.col("claims")))


def weak_components(nodes: DataFrame, edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, component) of every node; a node without edges is a component. Rounds work on 64-bit numbers of the ids; a component is named by its smallest id."""
    scratch = scratch or Scratch(nodes.sparkSession, "weak")
    number = lambda c: F.xxhash64(c)
    labels = connected_components(edges.select(number("subject_id").alias("a"), number("object_id").alias("b")), scratch=scratch)
    own = nodes.select("id", number("id").alias("node")).join(labels, "node", "left").select("id", F.coalesce("component", "node").alias("component"))
    own = scratch.write(own, "components")
    names = own.groupBy("component").agg(F.min("id").alias("name"))
    return own.join(names, "component").select("id", F.col("name").alias("component"))


def density(n: int, m: int) -> float:
    return m / (n * (n - 1)) if n > 1 else 0.0


def graph_stats(nodes: DataFrame, edges: DataFrame, k: int = 15) -> dict[str, object]:
    """The statistics document; every entry is a bounded aggregate."""
    pairs = lambda df, c: {r.value: r.n for r in distribution(df, c).orderBy(F.col("n").desc(), "value").collect()}
    n, m = nodes.count(), edges.count()
    cover = coverage(edges).first()
    weak = weak_components(nodes, edges).agg(F.count_distinct("component").alias("n")).first().n
    sources = edges.where(F.size("evidence") > 0).agg(F.count_distinct(F.get("evidence", F.lit(0))["source_id"]).alias("n")).first().n
    return {
        "total_nodes": n, "total_edges": m, "node_types": pairs(nodes, "type"), "relation_types": pairs(edges, "relation"), "claim_statuses": pairs(edges, "status"),
        "top_entities": [r.asDict() for r in top_degree(nodes, edges, k).orderBy(F.col("degree").desc(), "id").collect()],
        "total_evidence": cover.evidence, "grounded_claims": cover.grounded, "grounding_coverage": cover.coverage,
        "weak_components": weak, "density": density(n, m), "source_count": sources,
    }


def save_stats(spark: SparkSession, stats: dict[str, object], path: str) -> None:
    """The statistics document as one JSON row."""
    spark.createDataFrame([(json.dumps(stats),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_stats(spark: SparkSession, path: str) -> dict[str, object]:
    """What ``save_stats`` wrote; empty where there is nothing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return {}
    row = spark.read.text(path).first()
    return json.loads(row.value) if row else {}


def totals(entities: DataFrame, claims: DataFrame, merge_log: DataFrame) -> DataFrame:
    """One row: entities, claims and merges."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(entities, "entities").crossJoin(F.broadcast(one(claims, "claims"))).crossJoin(F.broadcast(one(merge_log, "merges")))


def share_percent(counts: DataFrame, total: str = "n") -> DataFrame:
    """Counts with ``pct`` of their sum; the sum is one row."""
    whole = counts.agg(F.sum(total).alias("__all"))
    return counts.crossJoin(F.broadcast(whole)).withColumn("pct", F.col(total) * 100.0 / F.greatest("__all", F.lit(1))).drop("__all")


def density_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n nodes, m edges, m / (n (n - 1))."""
    both = nodes.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(edges.agg(F.count(F.lit(1)).alias("m"))))
    return both.withColumn("density", F.when(F.col("n") > 1, F.col("m") / (F.col("n") * (F.col("n") - 1.0))).otherwise(0.0))


NODE_JSON = "id string, name string, type string"
LINK_JSON = "source string, target string, key string, relation string, confidence double, status string, valid_from string, valid_until string, evidence_count long"


def load_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a node-link export; edges have the columns of claims that the export keeps."""
    rows = spark.read.schema("kind string, json string").json(path)
    nodes = rows.where("kind = 'node'").select(F.from_json("json", NODE_JSON).alias("r")).select("r.*")
    links = rows.where("kind = 'link'").select(F.from_json("json", LINK_JSON).alias("r")).select("r.*")
    return nodes, links.withColumnsRenamed({"source": "subject_id", "target": "object_id", "key": "id"})


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node-link export as JSON lines: one row per node and per link (a graph never has to fit into one row)."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("id", "name", "type")).alias("json"))
    link = F.struct(F.col("subject_id").alias("source"), F.col("object_id").alias("target"), F.col("id").alias("key"), "relation", "confidence", "status", "valid_from", "valid_until", F.size("evidence").alias("evidence_count"))
    return n.unionByName(edges.select(F.lit("link").alias("kind"), F.to_json(link).alias("json")))


def two_hops(edges: DataFrame, start: str, hops: int = 2) -> DataFrame:
    """(id, hop) of everything within ``hops`` undirected steps of one node."""
    both = edges.select(F.col("subject_id").alias("a"), F.col("object_id").alias("b")).union(edges.select("object_id", "subject_id")).where("a <> b").distinct()
    reached = edges.sparkSession.createDataFrame([(start, 0)], "id string, hop int")
    front = reached
    for hop in range(1, hops + 1):
        nxt = both.join(front.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        front = nxt.join(reached, "id", "left_anti").withColumn("hop", F.lit(hop))
        reached = reached.unionByName(front)
    return reached
