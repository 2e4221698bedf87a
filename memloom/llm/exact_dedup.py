"""Stateful streaming exact deduplication, with DataFrame operations only.

Arrivals (digest, stable identifier, length, content locator; no text) are
written once and then read as a stream. The stream's state is keyed by digest,
lives in a disk-backed state store and never expires: for each digest it holds
the best row so far (its identifier and where its content is) and how many rows have
arrived. With ``state_dir`` the state outlives the call: the next call's arrivals go on
from it, and its documents are also compared with those of the calls before.

Equal digests are only hits. The full bytes of all hits are compared: within a
digest, distinct normalised texts are told apart, and if a digest turns out to
hold several, the call's rows of it are grouped by their bytes instead. What an earlier call
kept is read again by its locator for that. Rows that are no hits are left out before
any text is shuffled, by a broadcast of the hits' digests where they are counted to be few.

Copies collapse before each shuffle (partial aggregation). To give every document its
group's result back, documents are salted by their id; the state also remembers
which salts a group has, and its result is sent to just those. A group that holds a
third of all rows is thus never in one task.

Defined results: a null text counts as empty, and all empty or blank texts are
one group; of equal texts the longest original, then the smallest id stays; a row without
an id stays only where no row of its group has one, and then one of the longest of them does (its keep_id is null);
rows that repeat an id are one document (``group_size`` still counts rows); ids are of any ordered type; extra
columns are ignored by ``duplicate_groups`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators.scratch import Scratch

SALTS = 64
#: Hits whose digests are broadcast at most (about 20 MB); more are joined by digest and salt.
BROADCAST_GROUPS = 1 << 18
BLANKS = "[\\x20\\x09-\\x0D]"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def disk_state(spark: SparkSession):
    """Within it, streams keep their state on disk; restores the session's settings."""
    want = {
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def salt_of(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(SALTS)).cast("int").alias("salt")


def arrivals(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], batch: str) -> DataFrame:
    """What the stream reads for each document: no text, only where it is. ``row`` tells rows without an id apart."""
    body = normalised(F.col(text_col))
    return docs.select(
        F.col(id_col).alias("id"), digest(body).alias("digest"), sha256(body).alias("sha256"),
        F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long").alias("n_chars"),
        F.input_file_name().alias("file"), F.lit(batch).alias("batch"), F.monotonically_increasing_id().alias("row"), salt_of(F.col(id_col)),
    )


def first_place() -> Column:
    """Sorts the row that stays before all others: rows with an id, the longest, the smallest id."""
    return F.struct(F.col("id").isNull().alias("no_id"), (-F.col("n_chars")).alias("short"), "id", "batch", "row", "file")


def run_stream(spark: SparkSession, source: str, schema, target: str, bytes_per_batch: int) -> DataFrame:
    """Feed the arrivals in ``source`` that were not fed yet to the keyed state below ``target``; the state's rows by digest."""
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(source)
    state = stream.groupBy("digest").agg(F.min(first_place()).alias("best"), F.count(F.lit(1)).alias("group_size"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))

    def journal(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/journal/epoch={epoch}")

    with disk_state(spark):
        (state.writeStream.outputMode("update").foreachBatch(journal).option("checkpointLocation", f"{target}/stream")
         .trigger(availableNow=True).start().awaitTermination())
    kind = schema["id"].dataType.simpleString()
    best = f"best struct<no_id:boolean,short:long,id:{kind},batch:string,row:long,file:string>"
    rows = spark.read.option("basePath", f"{target}/journal").schema(f"digest string, {best}, group_size long, salts long, epoch long").parquet(f"{target}/journal/epoch=*")
    latest = rows.groupBy("digest").agg(F.max(F.struct("epoch", "best", "group_size", "salts")).alias("at"))
    return latest.select("digest", F.col("at.best.id").alias("keep_id"), F.col("at.best.batch").alias("keep_batch"), F.col("at.best.row").alias("keep_row"), F.col("at.best.file").alias("keep_file"), F.col("at.group_size").alias("group_size"), F.col("at.salts").alias("salts"))


def kept_before(hits: DataFrame, docs: DataFrame, batch: str, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame | None:
    """(digest, body) of what earlier calls kept of these hits, read by locator; None if there is nothing. Only files with a hit are read."""
    old = hits.where((F.col("keep_batch") != batch) & (F.col("keep_file") != "")).select("digest", F.col("keep_id"), "keep_file")
    files = [r.keep_file for r in old.select("keep_file").distinct().toLocalIterator()]
    if not files:
        return None
    texts = docs.sparkSession.read.schema(docs.select(id_col, text_col).schema).parquet(*files)
    body = normalised(F.col(text_col))
    texts = texts.select(F.col(id_col).alias("__id"), digest(body).alias("__digest"), body.alias("body"))
    return texts.join(old, F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("__digest") == F.col("digest"))).select("digest", "body")


def _grouped(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], bytes_per_batch: int, state_dir: str | None) -> tuple[DataFrame, DataFrame]:
    """(rows of the call with their group's result, groups)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    home, batch = state_dir or scratch.path, f"batch-{uuid.uuid4().hex[:12]}"
    arrivals(docs, id_col, text_col, digest, batch).write.parquet(f"{home}/arrivals/{batch}")
    came = spark.read.parquet(f"{home}/arrivals/{batch}")
    if came.isEmpty():
        groups = spark.createDataFrame([], f"digest string, keep_id {came.schema['id'].dataType.simpleString()}, keep_batch string, keep_row long, keep_file string, group_size long, salts long")
    else:
        groups = scratch.write(run_stream(spark, f"{home}/arrivals/*", came.schema, f"{home}/state", bytes_per_batch), "groups")
        if state_dir is None:
            scratch.drop("state")

    present = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit("salts", k) == 1)
    spread = groups.withColumn("salt", F.explode(present))
    hits = groups.where("group_size > 1")
    content = docs.select(F.col(id_col).alias("id"), digest(normalised(F.col(text_col))).alias("digest"), normalised(F.col(text_col)).alias("body"), salt_of(F.col(id_col)))
    if hits.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        of_hits = content.join(F.broadcast(hits.select("digest")), "digest", "left_semi")
    else:
        of_hits = content.join(spread.where("group_size > 1").select("digest", "salt"), ["digest", "salt"])
    bodies = of_hits.select("digest", "body")
    if (before := kept_before(hits, docs, batch, id_col, text_col, digest)) is not None:
        bodies = bodies.unionByName(before)
    variants = bodies.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    collided = scratch.write(variants.where("texts > 1").select("digest"), "collided")

    of_group = spread.select("digest", "salt", "keep_id", "keep_batch", "keep_row", "group_size")
    rows = came.join(of_group, ["digest", "salt"])
    if not collided.isEmpty():
        inside = came.join(collided, "digest", "left_semi")
        texts = content.join(collided, "digest", "left_semi").select("id", "digest", "body").dropDuplicates()
        told = inside.join(texts, inside["id"].eqNullSafe(texts["id"]) & (inside["digest"] == texts["digest"])).drop(texts["id"]).drop(texts["digest"])
        told = told.where(sha256(F.col("body")) == F.col("sha256"))
        own = told.groupBy("digest", "body").agg(F.min(first_place()).alias("best"), F.count(F.lit(1)).alias("group_size"))
        own = own.select("digest", "body", F.col("best.id").alias("keep_id"), F.col("best.batch").alias("keep_batch"), F.col("best.row").alias("keep_row"), "group_size")
        rows = rows.join(collided, "digest", "left_anti").unionByName(told.join(own, ["digest", "body"]).drop("body"))
    here = (F.col("batch") == F.col("keep_batch")) & (F.col("row") == F.col("keep_row"))
    kept = F.when(F.col("keep_id").isNull(), here).otherwise(F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)))
    return rows.withColumn("kept", kept), groups


def duplicate_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, bytes_per_batch: int = 64 << 30, state_dir: str | None = None) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    With ``state_dir`` (a shared folder of the caller) groups and keep_id also count the documents of earlier calls; those must have been read from Parquet files that are still there.
    """
    rows, _ = _grouped(docs, id_col, text_col, digest, bytes_per_batch, state_dir)
    return rows.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, bytes_per_batch: int = 64 << 30, state_dir: str | None = None) -> DataFrame:
    """The documents that stay, with all their columns; a document that is there in several rows stays once."""
    rows, _ = _grouped(docs, id_col, text_col, digest, bytes_per_batch, state_dir)
    stay = rows.where("kept").groupBy(F.col("id").alias("__keep_id")).agg(F.count(F.lit(1)).alias("__rows"))
    scratch = Scratch(docs.sparkSession, "exact")
    stay = scratch.write(stay.where("__keep_id is not null"), "stay")
    kept = docs.join(stay.select("__keep_id"), docs[id_col] == F.col("__keep_id"), "left_semi")
    kept = kept if stay.where("__rows > 1").isEmpty() else kept.dropDuplicates([id_col])
    nameless = scratch.write(rows.where("kept and id is null").select(F.col("sha256").alias("__sha")).distinct(), "nameless")
    if nameless.isEmpty():
        return kept
    # One of the longest rows of each text that no row with an id has.
    whole = F.struct(*[F.col(c) for c in docs.columns])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    alone = docs.where(F.col(id_col).isNull()).select(sha256(normalised(F.col(text_col))).alias("__sha"), F.length(text).alias("__n"), text.alias("__text"), whole.alias("__row"))
    alone = alone.join(nameless, "__sha", "left_semi").groupBy("__sha").agg(F.max_by("__row", F.struct("__n", "__text")).alias("r"))
    return kept.unionByName(alone.select("r.*"))
