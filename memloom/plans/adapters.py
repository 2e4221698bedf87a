"""Views of the driver's tables as messages, claims, entities and vectors, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom import schemas

NONE = "cast(null as string)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as messages: a turn answers the one before; the subject is the opening of the first turn."""
    t = table(spark, sf, "conversations")
    first = t.where("turn = 0").select("conv_id", F.substring("text", 1, 50).alias("subject"))
    return t.join(first, "conv_id", "left").selectExpr(
        "conv_id", "turn", "conv_id * 10000 + turn as seq", "concat(conv_id, '_', turn) as email_id", "concat('m', conv_id, '_', turn) as message_id",
        "case when turn > 0 then concat('m', conv_id, '_', turn - 1) else '' end as in_reply_to", "cast(array() as array<string>) as refs", "role as sender",
        "concat(case when role = 'user' then 'assistant' else 'user' end, ' , all-hands,, steam@x.org,') as recipients_raw", "subject", "lpad(cast(turn as string), 4, '0') as ts_raw", "text as body", "conv_id as thread_id",
    )


MSG = """m as (select c.conv_id, c.turn, c.conv_id * 10000 + c.turn seq, c.conv_id || '_' || c.turn email_id, c.role sender, f.subject, lpad(cast(c.turn as varchar), 4, '0') ts_raw, c.text body,
  case when c.role = 'user' then 'assistant' else 'user' end other
  from conversations c left join (select conv_id, substr(text, 1, 50) subject from conversations where turn = 0) f using (conv_id))"""


def event_claims(spark: SparkSession, sf: str) -> DataFrame:
    """events as status claims of users; the evidence of a claim is its event."""
    ev = F.struct(F.concat(F.lit("e"), (F.col("event_id") % 1000).cast("string")).alias("source_id"), F.col("props").alias("excerpt"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.lit("event").alias("source_type"), F.lit("").alias("author"), F.lit("").alias("subject"), F.lit(0).alias("char_offset_start"), F.lit(1).alias("char_offset_end"))
    e = table(spark, sf, "events").withColumn("evidence", F.array(ev).cast(f"array<{schemas.EVIDENCE}>"))
    return e.selectExpr(
        "event_id as seq", "concat('k', event_id) as id", "concat('u', user_id) as subject_id", "concat('user ', user_id) as subject_name", "'has_status' as relation",
        "concat('t', event_type) as object_id", "event_type as object_name", "least(1.0d, value / 100) as confidence", "'current' as status", "evidence",
        "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as valid_from", f"{NONE} as valid_until", f"{NONE} as superseded_by", "'v1' as extraction_version", "cast(map() as map<string,string>) as metadata",
    )


EVT = """c as (select event_id seq, 'k' || event_id id, 'u' || user_id subject_id, 'user ' || user_id subject_name, 't' || event_type object_id, event_type object_name,
  least(1.0, value / 100) confidence, strftime(ts, '%Y-%m-%d %H:%M:%S') valid_from, 'e' || (event_id % 1000) source_id, props excerpt from events)"""


def graph_entities(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    parts = [
        t("customer").selectExpr("concat('c', c_custkey) as id", "c_name as name", "'Person' as type"), t("supplier").selectExpr("concat('s', s_suppkey) as id", "s_name as name", "'Organisation' as type"),
        t("part").where("p_partkey % 10 <> 0").selectExpr("concat('p', p_partkey) as id", "p_name as name", "'Project' as type"), t("nation").selectExpr("concat('n', n_nationkey) as id", "n_name as name", "'Location' as type"),
        t("region").selectExpr("concat('r', r_regionkey) as id", "r_name as name", "'Location' as type"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def graph_claims(spark: SparkSession, sf: str) -> DataFrame:
    """The star schema as claims: suppliers to parts by their line items (evidence: order keys), members of nations and regions."""
    t = lambda n: table(spark, sf, n)
    ev = lambda src: F.struct(src.alias("source_id"), F.concat(F.lit("order "), src).alias("excerpt"), F.lit("").alias("timestamp"), F.lit("row").alias("source_type"), F.lit("").alias("author"), F.lit("").alias("subject"), F.lit(None).cast("int").alias("char_offset_start"), F.lit(None).cast("int").alias("char_offset_end"))
    li = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_discount").alias("d"), F.max("l_linestatus").alias("ls"), F.array_sort(F.collect_set("l_orderkey")).alias("orders"))
    sp = li.select(
        (F.col("l_suppkey") * 1_000_000 + F.col("l_partkey")).alias("seq"), F.concat(F.lit("sp"), "l_suppkey", F.lit("_"), "l_partkey").alias("id"), F.concat(F.lit("s"), "l_suppkey").alias("subject_id"),
        F.lit("related_to").alias("relation"), F.concat(F.lit("p"), "l_partkey").alias("object_id"), (F.col("d") * 10).cast("double").alias("confidence"), F.when(F.col("ls") == "O", "current").otherwise("historical").alias("status"),
        F.transform("orders", lambda o: ev(o.cast("string"))).cast(f"array<{schemas.EVIDENCE}>").alias("evidence"),
    )
    member = lambda df, k, a, b, base: df.select((F.lit(base) + F.col(k)).alias("seq"), F.concat(F.lit("m" + a), k).alias("id"), F.concat(F.lit(a), k).alias("subject_id"), F.lit("member_of").alias("relation"), b.alias("object_id"), F.lit(0.9).alias("confidence"), F.lit("current").alias("status"), F.array().cast(f"array<{schemas.EVIDENCE}>").alias("evidence"))
    out = sp
    out = out.unionByName(member(t("customer"), "c_custkey", "c", F.concat(F.lit("n"), "c_nationkey"), 10**13))
    out = out.unionByName(member(t("supplier"), "s_suppkey", "s", F.concat(F.lit("n"), "s_nationkey"), 2 * 10**13))
    out = out.unionByName(member(t("nation"), "n_nationkey", "n", F.concat(F.lit("r"), "n_regionkey"), 3 * 10**13))
    none = F.lit(None).cast("string")
    return out.withColumns({"subject_name": F.concat(F.lit("name "), "subject_id"), "object_name": F.concat(F.lit("name "), "object_id"), "valid_from": none, "valid_until": none})


GRAPH = """e as (select 'c' || c_custkey id, c_name as name, 'Person' as type from customer union all select 's' || s_suppkey, s_name, 'Organisation' from supplier
  union all select 'p' || p_partkey, p_name, 'Project' from part where p_partkey % 10 <> 0 union all select 'n' || n_nationkey, n_name, 'Location' from nation union all select 'r' || r_regionkey, r_name, 'Location' from region),
k0 as (select l_suppkey * 1000000 + l_partkey seq, 'sp' || l_suppkey || '_' || l_partkey id, 's' || l_suppkey subject_id, 'related_to' relation, 'p' || l_partkey object_id, cast(max(l_discount) * 10 as double) confidence,
    case when max(l_linestatus) = 'O' then 'current' else 'historical' end status, list_sort(list(distinct l_orderkey)) orders from lineitem group by l_suppkey, l_partkey
  union all select 10000000000000 + c_custkey, 'mc' || c_custkey, 'c' || c_custkey, 'member_of', 'n' || c_nationkey, 0.9, 'current', [] from customer
  union all select 20000000000000 + s_suppkey, 'ms' || s_suppkey, 's' || s_suppkey, 'member_of', 'n' || s_nationkey, 0.9, 'current', [] from supplier
  union all select 30000000000000 + n_nationkey, 'mn' || n_nationkey, 'n' || n_nationkey, 'member_of', 'r' || n_regionkey, 0.9, 'current', [] from nation),
k as (select *, 'name ' || subject_id subject_name, 'name ' || object_id object_name from k0)"""


def question(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where("vec_id = 0").select(F.lit("vector 0").alias("question"), F.col("embedding").cast("array<double>").alias("qvec"))


def supplier_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").selectExpr("concat('s', vec_id) as id", "cast(embedding as array<double>) as vec")
    return graph_entities(spark, sf).where("type = 'Organisation'").join(v, "id")


def claim_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Claims with the vector that their sequence number points to."""
    v = table(spark, sf, "embeddings").selectExpr("vec_id as __v", "cast(embedding as array<double>) as vec")
    return graph_claims(spark, sf).join(v, F.col("seq") % 500 == F.col("__v")).drop("__v")


SIM = "list_dot_product({a}, q) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product(q, q)) + 1e-9)"
VEC = GRAPH + """,
qv as (select cast(embedding as double[]) q from embeddings where vec_id = 0),
ev as (select e.*, cast(embedding as double[]) vec from e join embeddings on id = 's' || vec_id where type = 'Organisation'),
es as (select ev.id, name, type, """ + SIM.format(a="vec") + """ sim from ev, qv),
seeds as (select * from es order by sim desc, id limit 10),
s1 as (select k.id, object_id other from k join seeds on subject_id = seeds.id union all select k.id, subject_id from k join seeds on object_id = seeds.id),
ids as (select id from s1 union select k.id from k join (select distinct other from s1) n on subject_id = n.other),
cand as (select k.* from k join ids using (id)),
cs as (select cand.*, """ + SIM.format(a="cast(embedding as double[])") + """ sim from cand join embeddings on seq % 500 = vec_id, qv),
sc as (select *, 0.6 * sim + 0.2 * confidence + 0.2 * case when status = 'current' then 1.0 else 0.7 end score from cs),
rk as (select *, row_number() over (order by score desc, seq) as rnk from sc qualify row_number() over (order by score desc, seq) <= 20)"""
