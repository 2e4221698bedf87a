"""Named queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, lm_score, minhash, packing, perspectives, secrets, suffixes, token_count, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


@query("op9_benchmark_decontamination", """
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark),
bw as (select distinct item_id, least(len(w), 10) n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) p from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, n, unnest(range(1, len(w) - n + 2)) p, unnest(list_transform(range(1, len(w) - n + 2), lambda p: array_to_string(w[p : p + n - 1], ' '))) g from d, sizes where len(w) >= n),
hit as (select doc_id, p, dw.n, item_id from dw join bw on bw.n = dw.n and bw.g = dw.g),
words as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + n)) q from hit) group by 1),
items as (select doc_id, count(*) n_items, string_agg(i, ',' order by i) l from (select distinct doc_id, cast(item_id as varchar) i from hit) group by 1)
select d.doc_id, len(d.w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(l, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join words using (doc_id) left join items using (doc_id)""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op8_exact_dedup", """
select doc_id, keep_id, group_size, doc_id = keep_id kept, sha256(n) text_sha256 from (
  select doc_id, n, first_value(doc_id) over (partition by n order by length(coalesce(text, '')) desc, doc_id) keep_id, count(*) over (partition by n) group_size
  from (select doc_id, text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') n from documents))""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


@query("op2_perspective_rotation", """
with t as (select distinct conv_id, turn, case when trim(coalesce(role, '')) = '' then 'unknown' else role end as name, coalesce(text, '') as content from conversations),
p as (select distinct conv_id, name perspective from t where name <> 'system'),
e as (select conv_id, perspective, turn, name, content, case when name = perspective then 'assistant' when name = 'system' then 'system' else 'user' end as r from t join p using (conv_id)),
s as (select *, '<|' || r || '|>' || case when r = 'user' then name || ': ' else '' end as h from e),
g as (select *, h || content || '<|end|>' as segment from s),
w as (select *, row_number() over o - 1 as seq, cast(sum(length(segment)) over o - length(segment) as bigint) as b from g window o as (partition by conv_id, perspective order by turn, name, content rows unbounded preceding))
select conv_id, perspective, seq, turn, r as role, name, segment, b as start, length(segment) as length, r = 'assistant' as train,
  case when r = 'assistant' then b + length(h) end as train_start, case when r = 'assistant' then length(segment) - length(h) end as train_length from w""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), limit=2048)


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), capacity=1024, end_id=2)


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


@query("op7_minhash_near_dedup", """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
g as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 2)), lambda p: array_to_string(w[p : p + 3], ' '))) g from w where len(w) > 0),
n as (select doc_id, count(*) n from g group by 1),
c as (select a.doc_id a, b.doc_id b, count(*) k from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
u as (select a x, b y from l union all select b, a from l),
r(x, c) as (select distinct x, x from u union select u.y, r.c from r join u on u.x = r.x),
m as (select x, min(c) c from r group by 1)
select doc_id, coalesce(n, 0) n_shingles, coalesce(c, doc_id) component_id, coalesce(c, doc_id) = doc_id kept from documents left join n using (doc_id) left join m on x = doc_id""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


@query("op4_sparse_suffix_dedup", """
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
g as (select doc_id, unnest(range(0, len(w) - 49)) s, unnest(list_transform(range(1, len(w) - 48), lambda p: md5(array_to_string(w[p : p + 49], ' ')))) h from w where len(w) >= 50),
r as (select h, min(doc_id) low from g group by 1 having min(doc_id) <> max(doc_id)),
x as (select doc_id, s, low from g join r using (h)),
n as (select *, case when s <= lag(s) over (partition by doc_id order by s) + 50 then 0 else 1 end as fresh from x),
p as (select *, sum(fresh) over (partition by doc_id order by s rows unbounded preceding) part from n)
select doc_id, min(s) start_word, max(s) + 50 - min(s) n_words, min(low) first_doc_id from p group by doc_id, part""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = suffixes.repeated_spans(table(spark, sf_dir, "documents"), min_words=50)
    return spans.select("doc_id", "start_word", "n_words", "first_doc_id")


@query("op1_lm_score")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_score.scored(docs, table(spark, sf_dir, "labels"), label_col="quality", wanted=1, order=2, unit="word")
