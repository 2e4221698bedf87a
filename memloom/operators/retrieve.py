"""Question answering over the graph: similar entities, one-hop claims, composite ranking, evidence, context pack.

Questions are a small batch that is broadcast; seeds and ranked claims are top-k results per question and so bounded. Only the
scoring of entities reads a whole table with its vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom import schemas
from memloom.functions.vector import cosine, norm

from .scratch import Scratch

# Weights of the two rankings.
SIMILARITY_WEIGHT, CONFIDENCE_WEIGHT, STATUS_WEIGHT = 0.6, 0.2, 0.2
NOT_CURRENT, NO_CONFIDENCE = 0.7, 0.5
SEARCH_SIMILARITY, SEARCH_CONFIDENCE = 0.6, 0.4


ASKED = "question_id"


def asked(question: DataFrame) -> DataFrame:
    """Questions with an id; a table without ids is a single question."""
    return question if ASKED in question.columns else question.withColumn(ASKED, F.lit(0).cast("long"))


def similarity(rows: DataFrame, question: DataFrame, vec: str = "vec") -> DataFrame:
    """``rows`` once per question with its id and ``sim`` to its vector (column qvec). The batch of questions is what was
    asked, not what is stored, so it is broadcast; rows that carry a question's id already meet only that one."""
    q = asked(question).select(ASKED, F.col("qvec").cast("array<double>").alias("qvec")).withColumn("qnorm", norm(F.col("qvec")))
    met = rows.join(F.broadcast(q), ASKED) if ASKED in rows.columns else rows.crossJoin(F.broadcast(q))
    return met.withColumn("sim", cosine(F.col(vec), F.col("qvec"), None, F.col("qnorm"))).drop("qvec", "qnorm")


def best(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each question with ``rank`` from 1; each task keeps at most ``k`` of a question before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(ASKED).orderBy(*order))).where(F.col("rank") <= k)


def top_entities(entities: DataFrame, question: DataFrame, k: int = schemas.TOP_ENTITIES) -> DataFrame:
    """The ``k`` most similar entities of each question."""
    return best(similarity(entities, question), k, F.col("sim").desc(), F.col("id")).drop("rank")


def reached(claims: DataFrame, seeds: DataFrame) -> DataFrame:
    """(question_id, id): ids of claims at either end of a seed, and of claims that go out from a seed's neighbours; each once.

    Two passes over the claims' ids and ends, nothing else is carried: one explodes both ends and meets the seeds, one
    meets the neighbours.
    """
    start = F.broadcast(asked(seeds).select(ASKED, F.col("id").alias("node")).distinct())
    ends = claims.select("id", F.explode(F.array(F.struct(F.col("subject_id").alias("node"), F.col("object_id").alias("other")), F.struct(F.col("object_id").alias("node"), F.col("subject_id").alias("other")))).alias("e")).select("id", "e.*")
    touch = ends.join(start, "node").select(ASKED, "id", "other")
    near = touch.select(ASKED, F.col("other").alias("node")).distinct()
    beyond = claims.select("id", F.col("subject_id").alias("node")).join(near, "node").select(ASKED, "id")
    return touch.select(ASKED, "id").unionByName(beyond).distinct()


def one_hop(claims: DataFrame, seeds: DataFrame) -> DataFrame:
    """Claims at either end of a seed, and claims that go out from a seed's neighbours; each once per question. Ids are unique."""
    found = claims.join(reached(claims, seeds), "id")
    return found if ASKED in seeds.columns else found.drop(ASKED)


def claim_score(sim: Column, confidence: Column, status: Column) -> Column:
    boost = F.when(status == "current", 1.0).otherwise(NOT_CURRENT)
    return SIMILARITY_WEIGHT * sim + CONFIDENCE_WEIGHT * F.coalesce(confidence, F.lit(NO_CONFIDENCE)) + STATUS_WEIGHT * boost


def ranked_claims(candidates: DataFrame, question: DataFrame, k: int) -> DataFrame:
    """The best ``k`` claims of each question with score and rank (from 1)."""
    scored = similarity(candidates, question).withColumn("score", claim_score(F.col("sim"), F.col("confidence"), F.col("status")))
    return best(scored, k, F.col("score").desc(), F.col("seq"))


def evidence_snippets(ranked: DataFrame, most: int = 15) -> DataFrame:
    """Evidence of ranked claims, each (source, first 50 characters) once per question with the best claim."""
    each = ranked.select(ASKED, "rank", "score", "subject_name", "relation", "object_name", F.posexplode("evidence").alias("pos", "e"))
    key = F.concat("e.source_id", F.lit("|"), F.substring("e.excerpt", 1, 50))
    first = each.withColumn("rn", F.row_number().over(Window.partitionBy(ASKED, key).orderBy("rank", "pos"))).where("rn = 1")
    out = first.withColumn("rn", F.row_number().over(Window.partitionBy(ASKED).orderBy("rank", "pos"))).where(F.col("rn") <= most)
    support = F.concat("subject_name", F.lit(" —"), "relation", F.lit("→ "), "object_name")
    return out.select(ASKED, "rank", "pos", "e.source_id", "e.excerpt", "e.timestamp", "e.author", "e.subject", support.alias("supporting_claim"), F.round("score", 3).alias("relevance_score"))


def summary_line(status: Column, subject: Column, relation: Column, object_: Column, confidence: Column, evidence: Column) -> Column:
    mark = F.when(status == "current", "✓").otherwise("⟲")
    return F.format_string("[%s] %s —%s→ %s (confidence: %.2f, evidence: %d sources)", mark, subject, relation, object_, confidence, evidence)


def context_summary(ranked: DataFrame, most: int = 10) -> DataFrame:
    """One row per question: the summary lines of its best claims."""
    line = summary_line(F.col("status"), F.col("subject_name"), F.col("relation"), F.col("object_name"), F.col("confidence"), F.size("evidence"))
    lines = ranked.where(F.col("rank") <= most).groupBy(ASKED).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return lines.select(ASKED, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("context_summary"))


def context_packs(questions: DataFrame, entities: DataFrame, claims: DataFrame, k: int = schemas.TOP_ENTITIES) -> DataFrame:
    """One row per question: matched entities, relevant claims, evidence snippets and summary. ``questions``: question_id, question, qvec.

    Seeds and ranked claims are used several times and are a few rows per question, so they are written once.
    """
    scratch = Scratch(questions.sparkSession, "packs")
    seeds = scratch.write(top_entities(entities, questions, k), "seeds")
    ranked = scratch.write(ranked_claims(one_hop(claims, seeds), questions, 2 * k), "ranked")
    matched = seeds.groupBy(ASKED).agg(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("o"), "id", "name", "type", F.round("sim", 3).alias("score")))).alias("m"))
    matched = matched.select(ASKED, F.transform("m", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["score"].alias("score"))).alias("matched_entities"))
    fact = F.struct(
        "rank", F.col("subject_name").alias("subject"), "relation", F.col("object_name").alias("object"), "confidence", "status",
        F.size("evidence").alias("evidence_count"), "valid_from", "valid_until", F.round("score", 3).alias("relevance_score"),
    )
    facts = ranked.where(F.col("rank") <= 10).groupBy(ASKED).agg(F.array_sort(F.collect_list(fact)).alias("relevant_claims"))
    snippets = evidence_snippets(ranked)
    snippets = snippets.groupBy(ASKED).agg(F.array_sort(F.collect_list(F.struct(*[c for c in snippets.columns if c != ASKED]))).alias("evidence_snippets"))
    out = questions.select(ASKED, "question")
    for part in (matched, facts, snippets, context_summary(ranked)):
        out = out.join(part, ASKED, "left")
    kinds = {f.name: f.dataType for f in out.schema}
    empty = [F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in ("matched_entities", "relevant_claims", "evidence_snippets")]
    return out.select(ASKED, "question", *empty, F.coalesce("context_summary", F.lit("")).alias("context_summary"))


def context_pack(question: DataFrame, entities: DataFrame, claims: DataFrame, k: int = schemas.TOP_ENTITIES) -> DataFrame:
    """The pack of a single question. ``question``: question, qvec."""
    return context_packs(asked(question), entities, claims, k).drop(ASKED)


def formatted_answer(packs: DataFrame, facts: int = 8, evidence: int = 6, length: int = 250) -> DataFrame:
    """``packs`` with ``generated_answer``: the answer text without a language model."""
    fact = lambda c, i: F.concat(
        F.format_string("%d. [%s] **%s** —%s→ **%s** (confidence: %.0f%%, %d evidence sources)", i + 1, F.when(c["status"] == "current", "✓ Current").otherwise("⟲ Historical"), c["subject"], c["relation"], c["object"], c["confidence"] * 100, c["evidence_count"]),
        F.when(F.coalesce(c["valid_from"], F.lit("")) != "", F.concat(F.lit("\n   Valid from: "), c["valid_from"])).otherwise(""),
        F.when(F.coalesce(c["valid_until"], F.lit("")) != "", F.concat(F.lit("\n   Valid until: "), c["valid_until"])).otherwise(""),
    )
    proof = lambda e: F.concat(F.lit("- **["), e["source_id"], F.lit("]** ("), F.coalesce(e["author"], F.lit("?")), F.lit(", "), F.coalesce(e["timestamp"], F.lit("?")), F.lit('):\n  > "'), F.substring(e["excerpt"], 1, length), F.lit('"\n  _Supports: '), e["supporting_claim"], F.lit("_"))
    text = F.concat(
        # The layout of the answer.
        F.lit("**Question:** "), "question", F.lit("\n\n**Relevant Facts (from memory graph):**\n\n"), F.array_join(F.transform(F.slice("relevant_claims", 1, facts), fact), "\n"),
        F.lit("\n\n**Supporting Evidence:**\n\n"), F.array_join(F.transform(F.slice("evidence_snippets", 1, evidence), proof), "\n"),
    )
    return packs.withColumn("generated_answer", text)


def answer_prompt(packs: DataFrame) -> DataFrame:
    """``packs`` with ``prompt`` for an injected language model: question, summary and eight snippets, each to be cited."""
    cited = F.transform(F.slice("evidence_snippets", 1, 8), lambda e: F.concat(F.lit("  ["), e["source_id"], F.lit("] ("), F.coalesce(e["author"], F.lit("?")), F.lit(", "), F.coalesce(e["timestamp"], F.lit("?")), F.lit('): "'), F.substring(e["excerpt"], 1, 200), F.lit('"')))
    return packs.withColumn("prompt", F.concat(F.lit("Use only the context and evidence below, cite a source id for every fact, and tell current from historical facts.\n\nQuestion: "), "question", F.lit("\n\nContext:\n"), "context_summary", F.lit("\n\nEvidence:\n"), F.array_join(cited, "\n")))


def grounded_answers(packs: DataFrame, model: Callable[[str], str | None] | None = None) -> DataFrame:
    """Answers from an injected model; where there is none, or it gives nothing, the formatted answer."""
    out = answer_prompt(formatted_answer(packs))
    if model is None:
        return out

    def ask(batches):
        for pdf in batches:
            replies = [model(p) for p in pdf["prompt"]]
            pdf["generated_answer"] = [r or f for r, f in zip(replies, pdf["generated_answer"])]
            yield pdf

    return out.mapInPandas(ask, out.schema) if ASKED not in out.columns else out.drop("prompt", "generated_answer").join(out.select(ASKED, "prompt", "generated_answer").mapInPandas(ask, f"{ASKED} long, prompt string, generated_answer string"), ASKED)


def search_answer(found: DataFrame, most: int = 8) -> DataFrame:
    """One row: bullet points of a mixed search's best results. ``found``: kind, score, id, name, type, subject_name, relation, object_name, confidence, evidence_count."""
    spoken = F.replace(F.coalesce("relation", F.lit("?")), F.lit("_"), F.lit(" "))
    # The layout of a bullet.
    claim = F.format_string("• %s **%s** %s  *(confidence: %.0f%%, %d evidence)*", F.coalesce("subject_name", F.lit("?")), spoken, F.coalesce("object_name", F.lit("?")), F.coalesce("confidence", F.lit(0.0)) * 100, F.coalesce("evidence_count", F.lit(0)))
    line = F.when(F.col("kind") == "entity", F.format_string("• **%s** (%s)", "name", "type")).otherwise(claim)
    rows = found.withColumn("rn", F.row_number().over(Window.orderBy(F.col("score").desc(), "kind", "id"))).where(F.col("rn") <= most)
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", line.alias("line")))), lambda x: x["line"]), "\n").alias("answer"))


def search_prompt(found: DataFrame, question: str, most: int = 10) -> DataFrame:
    """One row: a prompt for an injected language model with the best results; claims bring two pieces of evidence."""
    proof = F.array_join(F.transform(F.slice(F.coalesce("evidence", F.array().cast(f"array<{schemas.EVIDENCE}>")), 1, 2), lambda e: F.concat(F.lit('; "'), F.substring(F.coalesce(e["excerpt"], F.lit("")), 1, 200), F.lit('" from '), F.coalesce(e["author"], F.lit("")), F.lit(" in "), F.coalesce(e["source_id"], F.lit("")))), "")
    claim = F.concat(F.lit("claim: "), F.format_string("%s %s %s, %.0f%% sure, %s", "subject_name", F.replace("relation", F.lit("_"), F.lit(" ")), "object_name", F.coalesce("confidence", F.lit(0.0)) * 100, F.coalesce("status", F.lit("current"))), proof)
    line = F.when(F.col("kind") == "entity", F.format_string("entity: %s, a %s", "name", "type")).otherwise(claim)
    rows = found.withColumn("rn", F.row_number().over(Window.orderBy(F.col("score").desc(), "kind", "id"))).where(F.col("rn") <= most)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", line.alias("line")))), lambda x: x["line"]), "\n")
    head = F.lit(f"Answer from these records alone, name the source of each fact, and say so if they are not enough.\n\n{question}\n\n")
    return rows.agg(F.concat(head, lines).alias("prompt"))


def search_reply(found: DataFrame, question: str, model: Callable[[str], str | None] | None) -> str | None:
    """The model's answer to one question from a mixed search; None without a model, and a message if it fails. The prompt is one bounded row."""
    if model is None:
        return None
    try:
        return model(search_prompt(found, question).first().prompt)
    except Exception as error:
        return f"model error: {error}"


def searched(found: DataFrame, entities: DataFrame, claims: DataFrame) -> DataFrame:
    """A mixed search's rows with what their answer shows; ``found`` is a top-k result and so broadcast."""
    few = F.broadcast(found)
    e = entities.join(few.where("kind = 'entity'"), "id").select("kind", "id", "score", "name", "type")
    c = claims.join(few.where("kind = 'claim'"), "id").select("kind", "id", "score", "subject_name", "relation", "object_name", "confidence", "status", "evidence", F.size("evidence").alias("evidence_count"))
    return e.unionByName(c, allowMissingColumns=True)


def mixed_search(entities: DataFrame, claims: DataFrame, question: DataFrame, k: int = 15) -> DataFrame:
    """Entities by similarity and all claims by similarity and confidence in one list."""
    e = similarity(entities, question).select(F.lit("entity").alias("kind"), "id", F.col("sim").alias("score"))
    c = similarity(claims, question).select(F.lit("claim").alias("kind"), "id", (SEARCH_SIMILARITY * F.col("sim") + SEARCH_CONFIDENCE * F.col("confidence")).alias("score"))
    return e.unionByName(c).orderBy(F.col("score").desc(), "kind", "id").limit(k)
