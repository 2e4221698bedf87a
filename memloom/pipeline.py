"""The five stages as one run: corpus, extraction, deduplication, graph, retrieval.

Extraction goes in waves of threads. A wave's tables are valid from the moment its list of finished threads is there, so a
run that was killed goes on with the threads that are not done. Sequence numbers come from sorting (thread, message,
rule, hit), never from arithmetic on the readers' keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom import schemas
from memloom.functions.text import entity_key
from memloom.functions.vector import HashedTrigrams, claim_text, entity_text
from memloom.operators import dedup, extract, graph, model_extract, retrieve, threads
from memloom.operators.scratch import Scratch
from memloom.sources.mail import Stage, write_json

WAVE_THREADS = 20_000


def extraction_rows(messages: DataFrame, model: Callable[[str], str | None] | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, claims) of schemas.ENTITY and schemas.CLAIM without ``seq``, but with thread_id and their ``place`` in it."""
    found = extract.rule_claims(messages)
    if model is not None:
        found = Scratch(messages.sparkSession, "model").write(model_extract.extracted(messages, found, model), "claims")
    made = extract.rule_entities(messages, found)
    none = F.array().cast("array<string>")
    no_metadata = F.map_from_arrays(none, none).alias("metadata")
    place = lambda msg, rule, hit: F.struct(msg.cast("long").alias("msg"), rule.cast("int").alias("rule"), hit.cast("int").alias("hit"))
    ents = made.select(
        "thread_id", place(F.coalesce("place.msg", F.lit(0)), F.col("place.rule"), F.col("place.hit")).alias("place"), "key", schemas.stable_id(F.col("thread_id"), F.col("key")).alias("id"), "name", "type",
        none.alias("aliases"), "first_seen", "last_seen", no_metadata,
    )
    ids = ents.select("thread_id", "key", F.col("id").alias("eid"))
    s, o = ids.toDF("t1", "k1", "subject_id"), ids.toDF("t2", "k2", "object_id")
    k = lambda side: entity_key(F.col(f"{side}_type"), F.col(f"{side}_name"))
    both = found.join(s, (found["thread_id"] == F.col("t1")) & (k("subject") == F.col("k1"))).join(o, (found["thread_id"] == F.col("t2")) & (k("object") == F.col("k2")))
    ev = F.struct("source_id", "excerpt", "timestamp", F.lit("email").alias("source_type"), "author", "subject", "char_offset_start", "char_offset_end")
    claims = both.select(
        "thread_id", place(F.col("msg"), F.col("rule"), F.col("hit")).alias("place"), schemas.stable_id(F.col("thread_id"), F.col("msg"), F.col("rule"), F.col("hit")).alias("id"),
        "subject_id", "subject_name", "relation", "object_id", "object_name", "confidence", F.lit("current").alias("status"), F.array(ev).cast(f"array<{schemas.EVIDENCE}>").alias("evidence"),
        "valid_from", F.lit(None).cast("string").alias("valid_until"), F.lit(None).cast("string").alias("superseded_by"), F.lit("v1").alias("extraction_version"), no_metadata,
    )
    return ents.drop("key"), claims


def sequenced(rows: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with ``seq``: unique numbers that grow with ``order``. Sorted by range and written, so a number never changes."""
    return scratch.write(rows.orderBy(*order).withColumn("seq", F.monotonically_increasing_id()), name)


def extraction_tables(messages: DataFrame, model: Callable[[str], str | None] | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, claims) of schemas.ENTITY and schemas.CLAIM from the rules and, if there is one, a language model, in thread order."""
    scratch = Scratch(messages.sparkSession, "extract")
    ents, claims = extraction_rows(messages, model)
    order = [F.col("thread_id"), F.col("place"), F.col("id")]
    made = [sequenced(rows, order, scratch, name).drop("place", "thread_id") for rows, name in ((ents, "entities"), (claims, "claims"))]
    return made[0].select("seq", *made[0].columns[:-1]), made[1].select("seq", *made[1].columns[:-1])


def thread_artifacts(chosen: DataFrame, claims: DataFrame) -> DataFrame:
    """(source_id, seq, excerpt) of each thread: the excerpt is that of its first claim that has one."""
    first = claims.where(F.coalesce(F.get("evidence", F.lit(0))["excerpt"], F.lit("")) != "").groupBy("thread_id").agg(F.min_by(F.get("evidence", F.lit(0))["excerpt"], "place").alias("excerpt"))
    return chosen.join(first, "thread_id", "left").select(F.col("thread_id").alias("source_id"), F.col("thread_rank").alias("seq"), F.coalesce("excerpt", F.lit("")).alias("excerpt"))


def run(spark: SparkSession, messages: DataFrame, out: str, *, questions: list[str] = (), least: int = schemas.THREAD_MIN, most: int = schemas.THREAD_MAX, target: int = schemas.THREAD_TARGET, similarity: float = schemas.SIMILARITY, skip_extract: bool = False, model: Callable[[str], str | None] | None = None, wave: int = WAVE_THREADS, answers: Callable[[str], str | None] | None = None) -> dict[str, object]:
    """Every stage is a written table; ``skip_extract`` uses an extraction that is there already, and a rerun goes on with an unfinished one.

    Messages with a thread_id are taken as the threads that they are; others are assembled and the best threads selected.
    """
    scratch = Scratch(spark, "build")
    stage = Stage(spark, f"{out}/extracted", "thread_id")
    if not (skip_extract and stage.exists()):
        if "thread_id" in messages.columns:  # threads as they came
            mail = scratch.write(messages, "mail")
            sequenced(mail.groupBy("thread_id").agg(F.min("seq").alias("first")), [F.col("first"), F.col("thread_id")], scratch, "ranked").select("thread_id", F.col("seq").alias("thread_rank")).write.mode("overwrite").parquet(f"{out}/threads")
        else:
            found, mail = threads.select_threads(messages, least=least, most=most, target=target)
            found.write.mode("overwrite").parquet(f"{out}/threads")
            mail = scratch.write(mail.drop("insert_ord"), "mail")
        todo = stage.todo(spark.read.parquet(f"{out}/threads").select("thread_id"))
        waves = -(-todo.count() // wave)
        for k in range(waves):
            own = todo.where(F.pmod(F.xxhash64("thread_id"), F.lit(waves)) == k)
            e, c = extraction_rows(mail.join(own, "thread_id", "left_semi"), model)
            stage.add(own, entities=e, claims=c)
    chosen = spark.read.parquet(f"{out}/threads")
    e, c = stage.read("entities"), stage.read("claims")
    done = dedup.Deduplicator(e, c, HashedTrigrams(), artifacts=thread_artifacts(chosen, c), similarity=similarity).run_full_pipeline()
    done.save(f"{out}/deduped")
    e, c = spark.read.parquet(f"{out}/deduped/entities"), spark.read.parquet(f"{out}/deduped/claims")
    nodes, edges = graph.build_graph(e, c)
    nodes, edges = scratch.write(nodes, "nodes"), scratch.write(edges, "edges")
    graph.node_link(nodes, edges).write.mode("overwrite").json(f"{out}/graph_json")
    stats = graph.graph_stats(nodes, edges)
    graph.save_stats(spark, stats, f"{out}/graph_stats")
    if questions:
        answer_questions(spark, e, c, list(questions), f"{out}/context_packs", answers)
    scratch.clear()
    return stats


def answer_questions(spark: SparkSession, entities: DataFrame, claims: DataFrame, questions: list[str], path: str, model: Callable[[str], str | None] | None = None) -> None:
    """A context pack and an answer per question, all in one plan: every table is scored against the whole batch at once."""
    embed = HashedTrigrams()
    ev = entities.select("id", "name", "type", embed(entity_text(F.col("name"), F.col("aliases"))).alias("vec"))
    cv = claims.withColumn("vec", embed(claim_text(F.col("subject_name"), F.col("relation"), F.col("object_name"))))
    asked = spark.createDataFrame(list(enumerate(questions)), "question_id long, question string").withColumn("qvec", embed(F.col("question")))
    write_json(retrieve.grounded_answers(retrieve.context_packs(asked, ev, cv), model).drop("prompt"), path)
