"""Queries behind the browsing pages: filters, search, graph view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entities(df: DataFrame, types: list[str] | None = None, search: str = "", limit: int = 50) -> DataFrame:
    """By type and by part of the name in any case; an empty search passes all."""
    out = df.where(F.col("type").isin(types)) if types else df
    if search:
        out = out.where(F.contains(F.lower("name"), F.lit(search.lower())))
    return out.orderBy("id").limit(limit)


def claims(df: DataFrame, relations: list[str] | None = None, statuses: list[str] | None = None, least: float = 0.0, search: str = "", limit: int = 50) -> DataFrame:
    out = df.where(F.col("confidence") >= least)
    if relations:
        out = out.where(F.col("relation").isin(relations))
    if statuses:
        out = out.where(F.col("status").isin(statuses))
    if search:
        hit = F.lit(False)
        for c in ("subject_name", "object_name", "relation"):
            hit = hit | F.contains(F.lower(c), F.lit(search.lower()))
        out = out.where(hit)
    return out.orderBy("seq").limit(limit)


def merges(log: DataFrame, types: list[str] | None = None, limit: int = 100) -> DataFrame:
    out = log.where(F.col("merge_type").isin(types)) if types else log
    return out.orderBy("id").limit(limit)


def merge_summary(log: DataFrame) -> DataFrame:
    """Merges by type and by the reason before its first equals sign."""
    return log.groupBy("merge_type", F.substring_index("reason", "=", 1).alias("reason_kind")).agg(F.count(F.lit(1)).alias("n"))


def graph_nodes(nodes: DataFrame, edges: DataFrame, types: list[str], highlight: str = "") -> DataFrame:
    """Nodes with a visible claim and a wanted type; those that do not match the highlight are faint."""
    seen = edges.where("status <> 'retracted'").select(F.explode(F.array("subject_id", "object_id")).alias("id")).distinct()
    match = F.lit(True) if not highlight else F.contains(F.lower("name"), F.lit(highlight.lower()))
    return nodes.join(seen, "id", "left_semi").where(F.col("type").isin(types)).withColumn("opacity", F.when(match, 1.0).otherwise(0.2))


def graph_edges(nodes: DataFrame, edges: DataFrame, types: list[str]) -> DataFrame:
    """Visible claims whose ends have a wanted type or are unknown; width and opacity by confidence."""
    kind = nodes.select("id", "type")
    s = kind.select(F.col("id").alias("subject_id"), F.col("type").alias("s_type"))
    o = kind.select(F.col("id").alias("object_id"), F.col("type").alias("o_type"))
    both = edges.where("status <> 'retracted'").join(s, "subject_id", "left").join(o, "object_id", "left")
    fits = lambda c: F.col(c).isNull() | F.col(c).isin(types)
    return both.where(fits("s_type") & fits("o_type")).withColumns({"width": F.greatest(F.lit(1.0), F.col("confidence") * 3), "opacity": F.greatest(F.lit(0.3), F.col("confidence"))})


def by_name(df: DataFrame, needle: str) -> DataFrame:
    """Entities whose name or an alias holds the needle in any case."""
    n = F.lit(needle.lower())
    return df.where(F.contains(F.lower("name"), n) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(F.lower(a), n)))


def claims_of(df: DataFrame, entity_id: str) -> DataFrame:
    return df.where((F.col("subject_id") == entity_id) | (F.col("object_id") == entity_id))


def claims_between(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where((F.least("subject_id", "object_id") == min(a, b)) & (F.greatest("subject_id", "object_id") == max(a, b)))


def highlight(nodes: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Nodes with a flag for those whose property is one of the values."""
    return nodes.withColumn("highlighted", F.coalesce(F.col(column).isin(values), F.lit(False)))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The values of a filter list in order; a null counts as an empty text."""
    return df.select(F.coalesce(F.col(column), F.lit("")).alias("value")).distinct().orderBy("value")
