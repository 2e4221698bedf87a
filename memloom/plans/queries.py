"""Named queries over the driver's tables, one or more per operator, each with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom import schemas
from memloom.functions import text as tx
from memloom.operators import browse, dedup, extract, graph, model_extract, retrieve, threads
from memloom.operators.components import connected_components
from memloom.operators.scratch import Scratch
from memloom.sources import mail
from memloom.store import MemoryStore
from memloom.streaming import ingest

from .adapters import EVT, GRAPH, MSG, VEC, claim_vectors, event_claims, graph_claims, graph_entities, messages, question, supplier_vectors, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# ── threads ──────────────────────────────────────────────────────────────────────────────────────────────────────
@query("select conv_id, turn, length(text) n from conversations where length(text) >= 60")
def msg_min_body_gate(spark, sf):
    return threads.body_gate(messages(spark, sf)).select("conv_id", "turn", F.length("body").cast("long").alias("n"))


@query("select conv_id, turn from conversations where conv_id in (select conv_id from conversations group by 1 having count(*) >= 5)")
def thread_min_messages(spark, sf):
    return threads.min_messages(messages(spark, sf), "conv_id", 5).select("conv_id", "turn")


CAP = MSG + """, n as (select conv_id from m group by 1 having count(*) >= 3),
cap as (select *, row_number() over (partition by conv_id order by ts_raw, seq) pos from m where conv_id in (select conv_id from n) qualify pos <= 6),
score as (select conv_id, count(*) message_count, count(distinct sender) n_senders, string_agg(distinct sender, ',' order by sender) participants,
  count(*) * 3 + count(distinct sender) * 5 + sum(length(body)) / 500.0 + 20 * count(*) filter (contains(lower(sender), 'assist')) score, any_value(subject) subject from cap group by 1)"""


def _capped(spark, sf):
    return threads.earliest(threads.min_messages(messages(spark, sf), "conv_id", 3), "conv_id", 6)


def _scores(spark, sf):
    return threads.scores(_capped(spark, sf), "conv_id", ("assist",))


@query(f"with {CAP} select conv_id, turn, pos from cap")
def thread_cap_earliest(spark, sf):
    return _capped(spark, sf).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"))


@query(f"with {CAP} select conv_id, message_count, n_senders, round(score, 6) score from score")
def thread_score(spark, sf):
    return _scores(spark, sf).select("conv_id", "message_count", F.size("participants").cast("long").alias("n_senders"), F.round("score", 6).alias("score"))


@query(f"with {CAP} select conv_id, participants from score")
def thread_participants(spark, sf):
    return _scores(spark, sf).select("conv_id", F.array_join("participants", ",").alias("participants"))


@query(f"with {CAP} select conv_id, round(score, 6) score from score order by score.score desc, conv_id limit 15")
def thread_select_topn(spark, sf):
    return _scores(spark, sf).orderBy(F.col("score").desc(), "conv_id").limit(15).select("conv_id", F.round("score", 6).alias("score"))


@query(f"with {CAP}, s as (select conv_id, round(score, 6) score, lower(trim(substr(subject, 1, 2))) nsubj from score) select conv_id, nsubj from s qualify row_number() over (partition by nsubj order by score desc, conv_id) = 1")
def thread_distinct_subject(spark, sf):
    first = messages(spark, sf).where("turn = 0").select("conv_id", tx.normalise_subject(F.substring("subject", 1, 2)).alias("nsubj"))
    s = _scores(spark, sf).withColumn("score", F.round("score", 6)).join(first, "conv_id")
    w = Window.partitionBy("nsubj").orderBy(F.col("score").desc(), "conv_id")
    return s.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("conv_id", "nsubj")


@query("select source, doc_id, row_number() over (partition by source order by case lang when 'en' then 0 when 'fr' then 1 else 2 end, doc_id) rn from documents qualify rn <= 20")
def mailbox_rank_cap(spark, sf):
    rank = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).otherwise(2)
    return mail.capped(table(spark, sf, "documents"), "source", [rank, F.col("doc_id")], 20).select("source", "doc_id", F.col("rn").cast("long").alias("rn"))


@query("""with recursive u as (select conv_id * 10000 + turn x, conv_id * 10000 + turn - 1 y from conversations where turn > 0 union all select conv_id * 10000 + turn - 1, conv_id * 10000 + turn from conversations where turn > 0),
r(x, c) as (select distinct x, x from u union select u.y, r.c from r join u on u.x = r.x) select x node, min(c) component from r group by 1""")
def thread_components(spark, sf):
    edges = messages(spark, sf).where("turn > 0").select(F.col("seq").alias("a"), (F.col("seq") - 1).alias("b"))
    return connected_components(edges)


@query(f"""with {MSG}, s as (select seq, lower(trim(regexp_replace(regexp_replace(subject, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'))) k from m)
select seq, case when k <> '' then min(seq) over (partition by k) else seq end first_seq from s""")
def thread_membership(spark, sf):
    keyed = threads.thread_keys(messages(spark, sf))
    return keyed.select("seq", F.min("seq").over(Window.partitionBy("thread_key")).alias("first_seq"))


@query("select conv_id, turn, substr(lower(regexp_replace(trim(regexp_replace('RE: Fw:  fwd : ' || replace(substr(text, 1, 140), chr(10), '  '), '^((re|fw|fwd)\\s*:\\s*)+', '', 'i')), '\\s+', ' ', 'g')), 1, 120) k from conversations")
def subject_normalise(spark, sf):
    raw = F.concat(F.lit("RE: Fw:  fwd : "), F.replace(F.substring("body", 1, 140), F.lit("\n"), F.lit("  ")))
    return messages(spark, sf).select("conv_id", "turn", tx.normalise_subject(raw).alias("k"))


# ── keys and normalisation ───────────────────────────────────────────────────────────────────────────────────────
@query("select doc_id, 'Project::' || lower(regexp_replace(substr(text, 1, 60), '^\\s+|\\s+$', '', 'g')) k from documents")
def canonical_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.entity_key(F.lit("Project"), F.substring("text", 1, 60)).alias("k"))


@query("select doc_id, md5(doc_id || '|' || substr(text, 1, 100)) fp from documents")
def evidence_fingerprint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.fingerprint(F.col("doc_id").cast("string"), F.col("text")).alias("fp"))


REL = ", ".join(f"'{r}'" for r in schemas.RELATIONS)


@query(f"""with r as (select event_id, case event_id % 7 when 0 then 'Reports To' when 1 then ' has_status ' when 2 then 'likes' when 3 then 'INVESTED IN' when 4 then ' invested in' when 5 then event_type else '  ' || props || ' ' end raw from events)
select event_id, case when lower(trim(raw)) in ({REL}) then lower(trim(raw)) when replace(lower(raw), ' ', '_') in ({REL}) then replace(lower(raw), ' ', '_') else 'related_to' end rel from r""")
def relation_normalise(spark, sf):
    raw = F.expr("case event_id % 7 when 0 then 'Reports To' when 1 then ' has_status ' when 2 then 'likes' when 3 then 'INVESTED IN' when 4 then ' invested in' when 5 then event_type else concat('  ', props, ' ') end")
    return table(spark, sf, "events").select("event_id", model_extract.relation(raw).alias("rel"))


@query("""with r as (select event_id, case event_id % 7 when 0 then 'Org ' when 1 then 'PERSON' when 2 then 'gizmo' when 3 then 'financial_instrument' when 4 then null when 5 then event_type else ' ROLE' end raw from events)
select event_id, case lower(trim(coalesce(raw, ''))) when 'org' then 'Organisation' when 'person' then 'Person' when 'financial_instrument' then 'FinancialInstrument' when 'role' then 'Role' else 'Project' end kind from r""")
def entity_type_normalise(spark, sf):
    raw = F.expr("case event_id % 7 when 0 then 'Org ' when 1 then 'PERSON' when 2 then 'gizmo' when 3 then 'financial_instrument' when 4 then null when 5 then event_type else ' ROLE' end")
    return table(spark, sf, "events").select("event_id", model_extract.entity_type(raw).alias("kind"))


# ── staged work ──────────────────────────────────────────────────────────────────────────────────────────────────
@query("select conv_id, turn from conversations where conv_id % 3 <> 0")
def resume_antijoin(spark, sf):
    m = messages(spark, sf)
    return mail.remaining(m, m.where("conv_id % 3 = 0"), "conv_id").select("conv_id", "turn")


@query("select 'flat_' || conv_id || '_' || turn thread_id, 1 message_count, role participants, length(text) body_chars from conversations")
def legacy_wrap(spark, sf):
    none = F.lit(None).cast("string")
    flat = messages(spark, sf).select(
        none.alias("thread_id"), "email_id", "message_id", "in_reply_to", F.lit("").alias("references"), F.col("sender").alias("from"), F.col("recipients_raw").alias("to"), "subject", F.col("ts_raw").alias("timestamp"), "body",
        F.lit(None).cast("array<string>").alias("participants"), F.lit(None).cast("array<struct<email_id:string,message_id:string,in_reply_to:string,references:string,`from`:string,`to`:string,subject:string,timestamp:string,body:string>>").alias("messages"),
    )
    return mail.wrapped(flat).select("thread_id", "message_count", F.array_join("participants", ",").alias("participants"), F.length(F.col("messages")[0]["body"]).cast("long").alias("body_chars"))


# ── rule extraction ──────────────────────────────────────────────────────────────────────────────────────────────
@query(f"""with {MSG}, r as (select *, unnest([other, 'all-hands', 'steam@x.org']) rcpt, unnest([0, 1, 3 - 1]) hit from m)
select seq msg, hit, case when contains(rcpt, '@') then 'Steam' else rcpt end object_name, case when contains(rcpt, 'all-') or contains(rcpt, 'team') then 'Organisation' else 'Person' end object_type,
'Email from ' || sender || ' to ' || rcpt || ' re: ' || coalesce(subject, '') excerpt from r""")
def sender_recipient_claims(spark, sf):
    return extract.sent_email(messages(spark, sf)).select("msg", F.col("hit").cast("long").alias("hit"), "object_name", "object_type", "excerpt")


@query("select page_id msg, url subject_name, 'Acme' object_name, cast(0.95 as double) confidence, 'Sender domain: ' || url excerpt from pages where contains(url, 'example.org')")
def domain_works_at(spark, sf):
    m = table(spark, sf, "pages").selectExpr("page_id as thread_id", "page_id as seq", "cast(page_id as string) as email_id", "url as sender", "'' as subject", "'' as ts_raw")
    return extract.works_at(m, "example.org", "Acme").select("msg", "subject_name", "object_name", "confidence", "excerpt")


def _docs_as_mail(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id as thread_id", "doc_id as seq", "cast(doc_id as string) as email_id", "source as sender", "concat('subject ', lang) as subject", "'' as ts_raw", "text as body")


def _window_sql(terms: str, start: int, end: str, name: str = "term") -> str:
    return f"""with lex as (select * from (values {terms}) v(hit, term)), p as (select doc_id msg, hit, term, text, lang, strpos(lower(text), lower(term)) - 1 a from documents, lex where contains(lower(text), lower(term)))
select msg, hit, {name} object_name, greatest(0, a - {start}) char_offset_start, least(length(text), a + {end}) char_offset_end,
md5(substr(regexp_replace(substr(text, greatest(0, a - {start}) + 1, least(length(text), a + {end}) - greatest(0, a - {start})), '^\\s+|\\s+$', '', 'g'), 1, 300)) excerpt_md5 from p"""


def _hits(df):
    return df.select("msg", "hit", "object_name", "char_offset_start", "char_offset_end", F.md5("excerpt").alias("excerpt_md5"))


@query(_window_sql("(0, 'the'), (1, 'of'), (2, 'Und'), (3, 'der'), (4, 'die'), (5, 'que')", 40, "length(term) + 120"))
def lexicon_first_hit_span(spark, sf):
    lex = (("the", "System"), ("of", "Project"), ("Und", "Organisation"), ("der", "Project"), ("die", "Project"), ("que", "Project"))
    return _hits(extract.known_names(_docs_as_mail(spark, sf), lex))


@query(_window_sql("(0, 'with'), (1, 'pour'), (2, 'nicht')", 60, "120", "upper(substr(term, 1, 1)) || substr(term, 2) || ' - subject ' || lang"))
def keyword_event_claims(spark, sf):
    return _hits(extract.keyword_events(_docs_as_mail(spark, sf), (("with", "approved"), ("pour", "decided"), ("nicht", "rejected"))))


@query(_window_sql("(0, 'that'), (1, 'las')", 40, "80"))
def location_context(spark, sf):
    return _hits(extract.locations(_docs_as_mail(spark, sf), ("that", "las")))


@query("""with p as (select page_id, html, regexp_split_to_array(html, '[0-9]{3}') parts, regexp_extract_all(html, '[0-9]{3}') hits from pages),
x as (select page_id, html, unnest(range(0, len(hits))) hit, unnest(hits) match, unnest(list_transform(range(1, len(hits) + 1), lambda i: length(array_to_string(parts[1 : i], '')) + 3 * (i - 1))) a from p)
select page_id, hit, match, a as start, a + 3 as "end", md5(substr(html, greatest(0, a - 80) + 1, least(length(html), a + 83) - greatest(0, a - 80))) context_md5 from x""")
def regex_spans_context(spark, sf):
    hits = extract.pattern_hits(table(spark, sf, "pages"), "[0-9]{3}", "html")
    start, end = tx.clamped(F.col("start") - 80, F.col("end") + 80, F.col("html"))
    return hits.select("page_id", "hit", "match", "start", "end", F.md5(tx.between(F.col("html"), start, end)).alias("context_md5"))


@query(f"""with {MSG} select relation, count(*) n from (select seq, unnest(['sent_email', 'sent_email', 'sent_email']) relation from m
  union all select seq, 'related_to' from m, (values ('london'), ('india'), ('houston'), ('portland'), ('california'), ('new york'), ('brazil'), ('argentina'), ('maharashtra'), ('mumbai'), ('enrononline'), ('eol'), ('raptor'), ('ljm'), ('ljm2'), ('chewco'), ('whitewing'), ('jedi'), ('marlin'), ('osprey'), ('azurix'), ('dabhol'), ('death star'), ('fat boy'), ('get shorty'), ('blockbuster'), ('arthur andersen'), ('andersen'), ('vinson & elkins'), ('dynegy'), ('ferc'), ('sec'), ('ubs warburg'), ('moody''s'), ('s&p'), ('chevrontexaco'), ('weil gotshal')) v(t) where contains(lower(body), t)
  union all select seq, r from m, (values ('approved', 'approved'), ('rejected', 'rejected'), ('decided', 'decided'), ('proposed', 'proposed'), ('recommend', 'proposed'), ('warned', 'warned_about'), ('concerned', 'warned_about'), ('investigating', 'investigated'), ('resigned', 'has_status'), ('terminated', 'has_status'), ('filed', 'has_status'), ('acquired', 'acquired'), ('downgrade', 'has_status'), ('bankruptcy', 'has_status')) v(t, r) where contains(lower(body), t)
  union all select seq, 'works_at' from m where contains(sender, 'enron.com')) group by 1""")
def rule_claim_counts(spark, sf):
    """Claims of all rules by relation, but for the two patterns that need Unicode classes."""
    found = extract.rule_claims(messages(spark, sf)).where("relation not in ('has_value', 'has_role')")
    return found.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


# ── model extraction ─────────────────────────────────────────────────────────────────────────────────────────────
@query("""with m as (select user_id, event_type, event_id pos from events where event_id % 3 = 0), r as (select user_id, event_type, event_id pos from events where event_id % 3 <> 0)
select user_id, event_type, pos, 0 prio from m union all
select user_id, event_type, pos, 1 from (select *, row_number() over (partition by user_id, event_type order by pos) rn from r where user_id in (select user_id from m) and (user_id, event_type) not in (select (user_id, event_type) from m)) where rn = 1
union all select user_id, event_type, pos, 1 from r where user_id not in (select user_id from m)""")
def llm_rule_merge_antijoin(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("pos"))
    return model_extract.merge_with_rules(e.where("pos % 3 = 0"), e.where("pos % 3 <> 0"), ["user_id", "event_type"])


@query(f"""with {MSG}, f as (select conv_id, email_id fid from m qualify row_number() over (partition by conv_id order by ts_raw, seq) = 1)
select m.seq pos, coalesce(o.email_id, f.fid) source_id, o.email_id is null evidence_fallback from m join f using (conv_id) left join m o on o.conv_id = m.conv_id and o.turn = m.turn + 2""")
def evidence_left_join_default(spark, sf):
    m = messages(spark, sf)
    claim = F.struct(F.lit("a").alias("subject"), F.lit("related_to").alias("relation"), F.lit("b").alias("object"), F.lit("0.5").alias("confidence"), F.lit("").alias("quote"), F.concat("conv_id", F.lit("_"), F.col("turn") + 2).alias("email_id"))
    parsed = m.groupBy("thread_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", claim.alias("c")))), lambda x: x["c"]).alias("claims"))
    out = model_extract.response_claims(parsed, m)
    return out.select((F.col("thread_id") * 10000 + F.col("pos")).alias("pos"), "source_id", "evidence_fallback")


@query(f"""with {MSG}, r as (select *, row_number() over (partition by conv_id order by ts_raw, seq) i from m), t as (select conv_id, arg_min(subject, i) subject, count(*) n, string_agg(distinct sender, ', ' order by sender) people,
  string_agg('#' || i || ' id=' || email_id || ' | ' || sender || ' -> ' || other || ' , all-hands,, steam@x.org, | ' || ts_raw || ' | ' || coalesce(subject, '') || chr(10) || substr(coalesce(body, ''), 1, 1000) || chr(10), chr(10) order by i) b from r group by 1)
select conv_id thread_id, md5('Thread ' || conv_id || ', ' || n || ' message(s), oldest first.' || chr(10) || 'About: ' || coalesce(subject, '') || chr(10) || 'Written by: ' || people || chr(10) || b || chr(10) || 'List what these messages state.') prompt_md5, substr(md5('Read'), 1, 8) h from t""")
def thread_prompts(spark, sf):
    """The whole prompt of every thread, in message order."""
    return model_extract.thread_prompts(messages(spark, sf)).select("thread_id", F.md5("prompt").alias("prompt_md5"), model_extract.prompt_hash("Read").alias("h"))


@query("""select event_id, case event_id % 4 when 0 then '{"k": 1}' when 1 then '{"k": 2}' when 2 then '{"k": 3}' end j, cast(case event_id % 4 when 3 then 0.7 else 0.25 * (event_id % 4) + case when event_id % 4 = 0 then 0.7 else 0 end end as double) c from events""")
def json_repair(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ['{"k": 1}', 'so:\n```json\n{"k": 2}\n```', 'prose {"k": 3} end', '{"k": '])), (F.col("event_id") % 4 + 1).cast("int"))
    conf = F.element_at(F.array(*map(F.lit, ["0", "0.25", "0.5", "high"])), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", model_extract.repaired_json(raw).alias("j"), model_extract.confidence(conf).alias("c"))


# ── deduplication ────────────────────────────────────────────────────────────────────────────────────────────────
ART = "a as (select doc_id, regexp_replace(lower(substr(text, 1, 100)), '^\\s+|\\s+$', '', 'g') k from documents)"


def _artifacts(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id as source_id", "doc_id as seq", "text as excerpt")
    return dedup.artifact_groups(d)


@query(f"with {ART} select doc_id, case when k <> '' then min(doc_id) over (partition by k) else doc_id end canonical_id from a")
def artifact_dedup(spark, sf):
    return _artifacts(spark, sf).select(F.col("source_id").alias("doc_id"), "canonical_id")


@query(f"with {ART} select min(doc_id) canonical_id, count(*) n from a where k <> '' group by k having count(*) > 1")
def artifact_groups(spark, sf):
    return _artifacts(spark, sf).where("group_size > 1 and artifact_key <> ''").groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n"))


def _parts(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey as seq", "concat('p', p_partkey) as id", "concat(p_brand, case when p_partkey % 2 = 0 then ' ' else '' end) as name", "p_type as type", "array(concat('size ', p_size % 5)) as aliases",
        "case when p_partkey % 7 = 0 then '' else date_format(date_add(date '2000-01-01', cast(p_partkey % 300 as int)), 'yyyy-MM-dd') end as first_seen", "date_format(date_add(date '2001-01-01', cast(p_partkey % 200 as int)), 'yyyy-MM-dd') as last_seen", "cast(map() as map<string,string>) as metadata",
    )


PART = """p as (select p_partkey seq, p_brand || case when p_partkey % 2 = 0 then ' ' else '' end as name, p_type as type, 'size ' || (p_size % 5) alias,
case when p_partkey % 7 = 0 then '' else strftime(date '2000-01-01' + cast(p_partkey % 300 as int), '%Y-%m-%d') end fs, strftime(date '2001-01-01' + cast(p_partkey % 200 as int), '%Y-%m-%d') ls from part),
g as (select type || '::' || lower(trim(name)) k, min(seq) wseq, arg_min(name, seq) wname, arg_min(alias, seq) walias, arg_min(fs, seq) wfs, min(nullif(fs, '')) f, max(ls) l, count(*) n from p group by 1),
al as (select k, x, min((seq, pos)) o from (select type || '::' || lower(trim(name)) k, seq, alias x, 0 pos from p union all select type || '::' || lower(trim(name)), seq, name, 1 from p) u join g using (k)
  where seq <> wseq and x <> walias and not (pos = 1 and x = wname) group by 1, 2)"""


@query(f"with {PART} select wseq seq, wname as name, n members, coalesce(f, wfs) first_seen, l last_seen, walias || coalesce('|' || (select string_agg(x, '|' order by o) from al where al.k = g.k), '') aliases from g")
def entity_exact_merge(spark, sf):
    e = dedup.exact_entities(_parts(spark, sf))
    return e.select("seq", "name", "members", "first_seen", "last_seen", F.array_join("aliases", "|").alias("aliases"))


COS = """pr as (select a.label, a.vec_id i, b.vec_id j, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-9) s
from (select *, cast(embedding as double[]) v from embeddings) a join (select *, cast(embedding as double[]) v from embeddings) b on a.label = b.label and a.vec_id < b.vec_id), ok as (select * from pr where s >= 0.3)"""


def _pairs(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("seq"), F.col("label").cast("string").alias("type"), F.col("embedding").alias("vec"))
    return dedup.cosine_pairs(v, 0.3)


@query(f"with {COS} select cast(label as varchar) as type, i, j, round(s, 6) similarity from ok")
def cosine_pairs(spark, sf):
    return _pairs(spark, sf).withColumn("similarity", F.round("similarity", 6))


@query(f"with recursive {COS}, u as (select i x, j y from ok union all select j, i from ok), r(x, c) as (select distinct x, x from u union select u.y, r.c from r join u on u.x = r.x) select x member, min(c) component from r group by 1")
def entity_components(spark, sf):
    """The partition that the ordered unions give, by smallest member."""
    roots, _ = dedup.union_order(Scratch(spark, "pairs").write(_pairs(spark, sf), "pairs"))
    return roots.select("member", F.min("member").over(Window.partitionBy("root")).alias("component"))


@query(f"with {EVT} select seq, case when seq % 2 = 0 then 'root' || (seq % 10) else subject_id end subject_id, case when object_name = 'click' then 'clicks' else object_id end object_id from c where seq % 2 = 0 or seq % 2 = 1")
def claim_remap_ids(spark, sf):
    c = event_claims(spark, sf).withColumn("subject_id", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("x"), (F.col("seq") % 10).cast("string"))).otherwise(F.col("subject_id")))
    remap = spark.createDataFrame([(f"x{k}", f"root{k}") for k in range(0, 10, 2)] + [("tclick", "clicks")], "id string, root_id string")
    return dedup.remapped(c, remap).select("seq", "subject_id", "object_id")


MERGE = EVT + ", w as (select subject_name, object_name, max((valid_from, seq)) top, count(*) occurrences, max(confidence) confidence from c group by 1, 2)"


def _merged(spark, sf):
    return dedup.merged_claims(event_claims(spark, sf))


@query(f"with {MERGE} select c.id, c.seq, occurrences, c.valid_from from w join c on c.subject_name = w.subject_name and c.object_name = w.object_name and (c.valid_from, c.seq) = w.top")
def claim_merge_winner(spark, sf):
    return _merged(spark, sf).select("id", "seq", "occurrences", "valid_from")


@query(f"with {EVT} select subject_name, object_name, round(max(confidence), 6) confidence from c group by 1, 2")
def claim_max_confidence(spark, sf):
    return _merged(spark, sf).select("subject_name", "object_name", F.round("confidence", 6).alias("confidence"))


@query(f"""with {MERGE}, i as (select c.subject_name, c.object_name, c.source_id, c.excerpt, (c.valid_from, c.seq) o, w.top, md5(source_id || '|' || substr(excerpt, 1, 100)) fp from c join w using (subject_name, object_name)),
own as (select subject_name, object_name, source_id, fp from i where o = top),
nw as (select subject_name, object_name, fp, arg_min(source_id, o) source_id, min(o) o from i where o <> top and (subject_name, object_name, fp) not in (select (subject_name, object_name, fp) from own) group by 1, 2, 3)
select subject_name, object_name, own.source_id || coalesce(',' || (select string_agg(nw.source_id, ',' order by nw.o) from nw where nw.subject_name = own.subject_name and nw.object_name = own.object_name), '') sources from own""")
def claim_merge_evidence(spark, sf):
    return _merged(spark, sf).select("subject_name", "object_name", F.array_join("evidence.source_id", ",").alias("sources"))


SUP = EVT + """, s as (select *, lead(object_name) over o nobj, lead(valid_from) over o nfrom, lead(id) over o nid from c window o as (partition by subject_id order by coalesce(valid_from, ''), seq)),
h as (select id, subject_id, case when nobj is not null and nobj <> object_name then 'historical' else 'current' end status, case when nobj <> object_name then nfrom end valid_until, case when nobj <> object_name then nid end superseded_by from s)"""


@query(f"with {SUP} select id, status, valid_until, superseded_by from h")
def temporal_supersede(spark, sf):
    return dedup.superseded(event_claims(spark, sf)).select("id", "status", "valid_until", "superseded_by")


@query(f"with {SUP} select subject_id, status, count(*) n from h group by 1, 2")
def status_history_counts(spark, sf):
    return dedup.superseded(event_claims(spark, sf)).groupBy("subject_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {EVT} select id from c where confidence >= 0.5")
def confidence_gate(spark, sf):
    return dedup.confident(event_claims(spark, sf)).select("id")


@query(f"with {GRAPH} select id from e where id not in (select subject_id from k where status = 'historical' union select object_id from k where status = 'historical')")
def orphan_entities(spark, sf):
    """Entities that no historical claim mentions."""
    return dedup.orphans(graph_entities(spark, sf), graph_claims(spark, sf).where("status = 'historical'")).select("id")


@query(f"with {GRAPH} select id from e where id in (select subject_id from k union select object_id from k)")
def referenced_entities(spark, sf):
    return dedup.referenced(graph_entities(spark, sf), graph_claims(spark, sf)).select("id")


@query("""with g as (select p_type || '::' || lower(trim(p_brand)) k, count(*) n from part group by 1) select 'entity' merge_type, 'exact_match' reason_kind, cast(sum(n - 1) as bigint) n from g""")
def merge_log_summary(spark, sf):
    return browse.merge_summary(dedup.exact_merges(_parts(spark, sf)))


def undone_last_merge(spark, sf):
    """All event claims merged and the last merge of the whole log undone: the store, the log before, the undone record and the result."""
    claims = event_claims(spark, sf)
    scratch = Scratch(spark, "undo")
    merged = scratch.write(dedup.merged_claims(claims).drop("occurrences", "key"), "claims")
    log = scratch.write(dedup.claim_merges(claims), "log")
    store = MemoryStore(spark.createDataFrame([], "id string, name string, type string, aliases array<string>"), merged, log)
    order = claims.select(F.col("id").alias("loser_id"), "seq")
    one = log.join(order, "loser_id").orderBy(F.desc("timestamp"), F.desc("seq")).first()
    return store, log, one, one is not None and store.undo_merge(one.id)


@query(f"with {EVT}, g as (select subject_name, object_name, count(*) n from c group by 1, 2) select (select count(*) from g where n > 1) > 0 undone, case when (select count(*) from g where n > 1) > 0 then 2 else 0 end restored, case when (select count(*) from g where n > 1) > 0 then -1 else 0 end log_change")
def undo_merge_roundtrip(spark, sf):
    """Merge all claims, undo the last merge, and compare with the snapshots."""
    store, log, one, undone = undone_last_merge(spark, sf)
    back = store.claims.where(F.col("id").isin(one.winner_id, one.loser_id)).count() if one else 0
    return spark.createDataFrame([(undone, back, store.merge_log.count() - log.count())], "undone boolean, restored long, log_change long")


# ── graph ────────────────────────────────────────────────────────────────────────────────────────────────────────
@query(f"with {GRAPH}, x as (select object_id id, object_name as name, seq from k union all select subject_id, subject_name, seq from k) select id, arg_min(name, seq) as name, 'Unknown' as type from x where id not in (select id from e) group by 1")
def stub_nodes(spark, sf):
    return graph.stub_nodes(graph_entities(spark, sf), graph_claims(spark, sf))


@query(f"with {GRAPH} select subject_id, object_id, id, relation, round(confidence, 6) confidence, status, len(orders) evidence_count from k")
def graph_edges(spark, sf):
    _, edges = graph.build_graph(graph_entities(spark, sf), graph_claims(spark, sf))
    return edges.select("subject_id", "object_id", "id", "relation", F.round("confidence", 6).alias("confidence"), "status", F.size("evidence").cast("long").alias("evidence_count"))


NODES = GRAPH + ", nd as (select * from e union all select distinct object_id, object_name, 'Unknown' from k where object_id not in (select id from e))"


def _graph(spark, sf):
    return graph.build_graph(graph_entities(spark, sf), graph_claims(spark, sf))


@query(f"with {NODES} select type as value, count(*) n from nd group by 1")
def node_type_dist(spark, sf):
    return graph.distribution(_graph(spark, sf)[0], "type")


@query(f"with {GRAPH} select relation as value, count(*) n from k group by 1")
def relation_dist(spark, sf):
    return graph.distribution(graph_claims(spark, sf), "relation")


@query(f"with {GRAPH} select status as value, count(*) n from k group by 1")
def status_dist(spark, sf):
    return graph.distribution(graph_claims(spark, sf), "status")


@query(f"with {GRAPH} select relation, status, count(*) n from k group by grouping sets ((relation), (status), ())")
def dist_grouping_sets(spark, sf):
    c = graph_claims(spark, sf)
    return c.groupingSets([[F.col("relation")], [F.col("status")], []], "relation", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {GRAPH}, d as (select relation, count(*) n from k group by 1) select relation, round(n * 100.0 / greatest(sum(n) over (), 1), 6) pct from d")
def dist_share_pct(spark, sf):
    shares = graph.share_percent(graph.distribution(graph_claims(spark, sf), "relation"))
    return shares.select(F.col("value").alias("relation"), F.round("pct", 6).alias("pct"))


@query(f"with {NODES}, d as (select id, count(*) degree from (select subject_id id from k union all select object_id from k) group by 1) select nd.id, type, degree from d join nd using (id) order by degree desc, id limit 15")
def top_degree(spark, sf):
    return graph.top_degree(*_graph(spark, sf)).select("id", "type", "degree")


@query(f"with {GRAPH} select count(*) claims, cast(sum(len(orders)) as bigint) evidence, count(*) filter (len(orders) > 0) grounded, printf('%.1f%%', 100.0 * count(*) filter (len(orders) > 0) / greatest(count(*), 1)) coverage from k")
def evidence_coverage(spark, sf):
    return graph.coverage(graph_claims(spark, sf))


@query(f"with {GRAPH} select count(distinct orders[1]) sources from k where len(orders) > 0")
def first_evidence_sources(spark, sf):
    return graph_claims(spark, sf).where(F.size("evidence") > 0).agg(F.count_distinct(F.get("evidence", F.lit(0))["source_id"]).alias("sources"))


@query("""with recursive mem as (select n_nationkey a, n_regionkey b from nation), cc as (select count(distinct r_regionkey) n from region where r_regionkey in (select b from mem)),
lp as (select distinct l_suppkey s, l_partkey p from lineitem), sr as (select s_suppkey s, n_regionkey r from supplier join nation on s_nationkey = n_nationkey),
u as (select distinct a.r x, b.r y from (select p, r from lp join sr using (s)) a join (select p, r from lp join sr using (s)) b using (p)),
r(x, c) as (select r_regionkey, r_regionkey from region union select u.y, r.c from r join u on u.x = r.x), m as (select x, min(c) c from r group by 1),
lone as (select count(*) n from part where p_partkey % 10 <> 0 and p_partkey not in (select p from lp)) select (select count(distinct c) from m) + (select n from lone) components""")
def wcc_count(spark, sf):
    scratch = Scratch(spark, "wcc")
    nodes, edges = _graph(spark, sf)
    edges = scratch.write(edges.select("subject_id", "object_id"), "edges")
    return graph.weak_components(nodes, edges, scratch).agg(F.count_distinct("component").alias("components"))


@query(f"with {NODES}, a as (select (select count(*) from nd) n, (select count(*) from k) m) select n, m, round(m / (n * (n - 1.0)), 9) density from a")
def graph_density(spark, sf):
    return graph.density_table(*_graph(spark, sf)).withColumn("density", F.round("density", 9))


# ── retrieval ────────────────────────────────────────────────────────────────────────────────────────────────────
def _seeds(spark, sf):
    return retrieve.top_entities(supplier_vectors(spark, sf), question(spark, sf))


def _ranked(spark, sf):
    scratch = Scratch(spark, "ranked")
    seeds = scratch.write(_seeds(spark, sf), "seeds")
    return scratch.write(retrieve.ranked_claims(retrieve.one_hop(claim_vectors(spark, sf), seeds), question(spark, sf), 20), "ranked")


@query(f"with {VEC} select id, name, round(sim, 6) sim from seeds")
def entity_topk(spark, sf):
    return _seeds(spark, sf).select("id", "name", F.round("sim", 6).alias("sim"))


@query(f"with {VEC} select id from cand")
def one_hop_expand(spark, sf):
    seeds = Scratch(spark, "seeds").write(_seeds(spark, sf), "seeds")
    return retrieve.reached(graph_claims(spark, sf), seeds).select("id")


@query(f"with {VEC} select rnk as rank, id, round(score, 6) score from rk")
def claim_rank(spark, sf):
    return _ranked(spark, sf).select(F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


SNIP = VEC + """, x as (select rnk, subject_name, object_name, relation, cast(unnest(orders) as varchar) src, unnest(range(0, len(orders))) pos from rk),
sn as (select * from x qualify row_number() over (partition by src || '|' || substr('order ' || src, 1, 50) order by rnk, pos) = 1 order by rnk, pos limit 15)"""


@query(f"with {SNIP} select rnk as rank, pos, src source_id, subject_name || ' —' || relation || '→ ' || object_name supporting_claim from sn")
def evidence_snippets(spark, sf):
    return retrieve.evidence_snippets(_ranked(spark, sf)).select(F.col("rank").cast("long").alias("rank"), F.col("pos").cast("long").alias("pos"), "source_id", "supporting_claim")


@query(f"with {VEC} select string_agg('[' || case when status = 'current' then '✓' else '⟲' end || '] ' || subject_name || ' —' || relation || '→ ' || object_name || ' (confidence: ' || printf('%.2f', confidence) || ', evidence: ' || len(orders) || ' sources)', chr(10) order by rnk) context_summary from rk where rnk <= 10")
def context_summary(spark, sf):
    return retrieve.context_summary(_ranked(spark, sf)).select("context_summary")


@query(f"with {SNIP} select 'vector 0' question, (select count(*) from seeds) entities, (select count(*) from rk where rnk <= 10) claims, (select count(*) from sn) snippets, (select string_agg(id, ',' order by sim desc, id) from seeds) entity_ids")
def context_pack(spark, sf):
    """The flagship: a question's context pack, reduced to countable parts."""
    pack = flagship(spark, sf)
    return pack.select(
        "question", F.size("matched_entities").cast("long").alias("entities"), F.size("relevant_claims").cast("long").alias("claims"), F.size("evidence_snippets").cast("long").alias("snippets"),
        F.array_join(F.transform("matched_entities", lambda e: F.concat(F.lit("s"), F.regexp_extract(e["name"], "([0-9]+)$", 1).cast("int").cast("string"))), ",").alias("entity_ids"),
    )


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.formatted_answer(retrieve.context_pack(question(spark, sf), supplier_vectors(spark, sf), claim_vectors(spark, sf)))


@query(f"""with {VEC}, allc as (select k.id, 0.6 * ({"list_dot_product(cast(embedding as double[]), q) / (sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) * sqrt(list_dot_product(q, q)) + 1e-9)"}) + 0.4 * confidence s from k join embeddings on seq % 500 = vec_id, qv)
select kind, id, round(s, 6) score from (select 'entity' kind, id, sim s from es union all select 'claim', id, s from allc) order by s desc, kind, id limit 15""")
def ui_search_mixed(spark, sf):
    return retrieve.mixed_search(supplier_vectors(spark, sf), claim_vectors(spark, sf), question(spark, sf)).withColumn("score", F.round("score", 6))


# ── browsing ─────────────────────────────────────────────────────────────────────────────────────────────────────
@query(f"with {GRAPH} select id, name from e where type in ('Person', 'Location') and contains(lower(name), 'a') order by id limit 50")
def browse_entities(spark, sf):
    return browse.entities(graph_entities(spark, sf), ["Person", "Location"], "A").select("id", "name")


@query(f"with {GRAPH} select id from k where relation in ('related_to') and status in ('current') and confidence >= 0.5 and (contains(lower(subject_name), 's1') or contains(lower(object_name), 's1') or contains(relation, 's1')) order by seq limit 50")
def browse_claims(spark, sf):
    return browse.claims(graph_claims(spark, sf), ["related_to"], ["current"], 0.5, "S1").select("id")


@query(f"with {NODES} select id, cast(case when contains(lower(name), 'supp') then 1.0 else 0.2 end as double) opacity from nd where id in (select subject_id from k where status <> 'retracted' union select object_id from k where status <> 'retracted') and type in ('Organisation', 'Location')")
def graph_view_nodes(spark, sf):
    nodes, edges = _graph(spark, sf)
    return browse.graph_nodes(nodes, edges, ["Organisation", "Location"], "Supp").select("id", "opacity")


@query(f"with {GRAPH} select k.id, round(greatest(1, confidence * 3), 6) width, round(greatest(0.3, confidence), 6) opacity from k left join e s on s.id = subject_id left join e o on o.id = object_id where coalesce(s.type in ('Organisation', 'Project'), true) and coalesce(o.type in ('Organisation', 'Project'), true)")
def graph_view_edges(spark, sf):
    e = browse.graph_edges(graph_entities(spark, sf), graph_claims(spark, sf), ["Organisation", "Project"])
    return e.select("id", F.round("width", 6).alias("width"), F.round("opacity", 6).alias("opacity"))


@query(f"""with {GRAPH}, b as (select subject_id a, object_id b from k union select object_id, subject_id from k), h1 as (select distinct b id from b where a = 'n3' and b <> 'n3'),
h2 as (select distinct b id from b where a in (select id from h1) and b <> 'n3' and b not in (select id from h1)) select 'n3' id, 0 hop union all select id, 1 from h1 union all select id, 2 from h2""")
def two_hop_highlight(spark, sf):
    return graph.two_hops(graph_claims(spark, sf), "n3")


@query(f"with {GRAPH} select id from k where subject_id = 's7' or object_id = 's7'")
def claims_for_entity(spark, sf):
    return browse.claims_of(graph_claims(spark, sf), "s7").select("id")


@query(f"with {GRAPH} select id from k where (subject_id = 'n3' and object_id = 'r1') or (subject_id = 'r1' and object_id = 'n3') or (subject_id in ('s1', 'n17') and object_id in ('s1', 'n17')) or (subject_id = 'n0' and object_id = 'r0')")
def claims_between(spark, sf):
    c = graph_claims(spark, sf)
    pairs = [browse.claims_between(c, a, b).select("id") for a, b in (("r1", "n3"), ("s1", "n17"), ("r0", "n0"))]
    return pairs[0].union(pairs[1]).union(pairs[2])


@query("select p_partkey from part where contains(lower(p_name), 'an') or contains(lower(p_brand), 'an')")
def find_by_name(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"))
    return browse.by_name(p, "AN").select("p_partkey")


# ── extensions ───────────────────────────────────────────────────────────────────────────────────────────────────
def _sourced(spark, sf):
    return _merged(spark, sf).select("id", "status", "confidence", "evidence")


@query(f"with {MERGE} select 'k' || t id, case when count(*) filter (cast(substr(source_id, 2) as int) % 50 <> 0) = 0 then 'retracted' else 'current' end status from (select (w.top)[2] t, source_id from c join w using (subject_name, object_name)) group by t")
def retract_source(spark, sf):
    gone = spark.range(0, 1000, 50).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("source_id"))
    return ingest.retract_source(_sourced(spark, sf), gone).select("id", "status")


@query(f"with {MERGE} select distinct 'k' || (w.top)[2] id from c join w using (subject_name, object_name) where cast(substr(source_id, 2) as int) < 100")
def acl_visible_claims(spark, sf):
    acl = spark.range(0, 100).select(F.lit("ann").alias("principal"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("source_id"))
    return ingest.visible_claims(_sourced(spark, sf), acl, "ann").select("id")


@query(f"with {MERGE} select 'k' || (w.top)[2] id from c join w using (subject_name, object_name) group by w.top, w.confidence having count(distinct source_id) >= 2 and w.confidence >= 0.7")
def durable_claims(spark, sf):
    return ingest.durable_claims(_sourced(spark, sf)).select("id")


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') window_start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def event_windows(spark, sf):
    w = ingest.windowed_counts(table(spark, sf, "events"))
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""with g as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 30 minute then 0 else 1 end b from events),
s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) k from g) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') session_start, count(*) n from s group by user_id, k""")
def event_sessions(spark, sf):
    return ingest.sessions(table(spark, sf, "events")).select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


@query("select count(*) messages, count(distinct conv_id) threads, cast(sum(length(text)) as bigint) chars from conversations")
def message_totals(spark, sf):
    return messages(spark, sf).agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("conv_id").alias("threads"), F.sum(F.length("body")).alias("chars"))


@query(f"with {GRAPH}, {EVT} select (select count(*) from e) entities, (select count(*) from (select distinct subject_name, object_name from c)) claims, (select count(*) from c) - (select count(*) from (select distinct subject_name, object_name from c)) merges")
def store_totals(spark, sf):
    return graph.totals(graph_entities(spark, sf), _merged(spark, sf), dedup.claim_merges(event_claims(spark, sf)))


@query(f"with {GRAPH} select distinct type as value from e union all select distinct relation from k union all select distinct status from k")
def distinct_lists(spark, sf):
    e, c = graph_entities(spark, sf), graph_claims(spark, sf)
    return browse.distinct_values(e, "type").union(browse.distinct_values(c, "relation")).union(browse.distinct_values(c, "status"))


@query("""select conv_id thread_id, count(*) message_count, string_agg(distinct role, ',' order by role) participants, md5(string_agg(text, chr(10) order by turn)) bodies_md5 from conversations group by 1""")
def nested_threads(spark, sf):
    t = threads.nested(messages(spark, sf))
    return t.select("thread_id", "message_count", F.array_join("participants", ",").alias("participants"), F.md5(F.array_join(F.transform("messages", lambda m: m["body"]), "\n")).alias("bodies_md5"))
