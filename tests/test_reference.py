"""Conformance cases: tiny inputs whose results were derived by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from memloom import schemas
from memloom.functions import text as tx
from memloom.functions.vector import HashedTrigrams, cosine, norm
from memloom.operators import browse, dedup, extract, graph, model_extract, retrieve, threads
from memloom.operators.components import connected_components
from memloom.sources import mail
from memloom.store import MemoryStore
from memloom.streaming import ingest

NONE = "cast(null as string)"


def mails(spark, rows):
    """rows: (seq, message_id, in_reply_to, refs, sender, recipients, subject, ts, body)"""
    schema = "seq long, message_id string, in_reply_to string, refs array<string>, sender string, recipients_raw string, subject string, ts_raw string, body string"
    return spark.createDataFrame(rows, schema).withColumn("email_id", F.concat(F.lit("e"), "seq"))


def claims(spark, rows):
    """rows: (seq, subject_id, subject_name, relation, object_id, object_name, confidence, valid_from, [(source, excerpt)])"""
    out = []
    for seq, sid, sn, rel, oid, on, conf, at, ev in rows:
        out.append((seq, f"c{seq}", sid, sn, rel, oid, on, conf, "current", [(s, x, at, "email", "a", "s", 0, 1) for s, x in ev], at, None, None, "v1", {}))
    return spark.createDataFrame(out, schemas.CLAIM)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


# ── strings ──────────────────────────────────────────────────────────────────────────────────────────────────────
def test_python_string_semantics(spark):
    assert one(spark, tx.title, "vince o'brien jean-luc abc1def") == "Vince O'Brien Jean-Luc Abc1Def"
    assert one(spark, tx.strip, "\n a \t") == "a"
    assert one(spark, tx.normalise_subject, "RE: Fw:  fwd : Hello   W") == "hello w"
    assert one(spark, tx.normalise_subject, None) == ""
    assert one(spark, tx.words, "  a \n b ") == ["a", "b"]
    assert one(spark, tx.person_name, "jo.day@enron.com") == "Jo Day" and one(spark, tx.person_name, "team") == "team"
    assert one(spark, tx.html_escape, "<a href='x'>&") == "&lt;a href=&#x27;x&#x27;&gt;&amp;"
    assert one(spark, lambda c: tx.find_folded(c, F.lit("ÄB")), "\U0001f600xäb") == 2


def test_money_spans(spark):
    body = "up $394M\nat $2.8B in $5. and $1,200.50, x$3Mx é$7 $9é chief  risk officer"
    got = [(s.start, s.match) for s in one(spark, lambda c: tx.spans(c, extract.MONEY), body)]
    assert got == [(3, "$394M"), (12, "$2.8B"), (21, "$5"), (29, "$1,200.50"), (47, "$7")]
    assert all(body[s : s + len(m)] == m for s, m in got)
    assert [s.match for s in one(spark, lambda c: tx.spans(c, extract.TITLES), body)] == ["chief  risk officer"]
    assert one(spark, lambda c: tx.spans(c, extract.MONEY), "none") == []


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>")
    r = df.select(cosine(F.col("a"), F.col("b")).alias("c"), norm(F.col("a")).alias("n")).first()
    assert r.c == pytest.approx(0.96, abs=1e-9) and r.n == 5.0
    v = one(spark, HashedTrigrams(16), "Hello")
    assert len(v) == 16 and sum(x * x for x in v) == pytest.approx(1)


# ── threads ──────────────────────────────────────────────────────────────────────────────────────────────────────
def test_thread_membership(spark):
    m = mails(spark, [(0, "a", "", [], "s", "", "X", "1", ""), (1, "b", "a", [], "s", "", "Re: X", "3", ""), (2, "", "", [], "s", "", "FW:  x ", "2", ""), (3, "d", "zz", [], "s", "", "Y", "4", "")])
    got = threads.thread_keys(m).orderBy("thread_key", "ts_raw", "insert_ord").collect()
    assert [(r.thread_key, r.seq) for r in got] == [("subj::x", 0), ("subj::x", 2), ("subj::x", 1), ("zz", 3)]


def test_blank_subjects(spark):
    m = mails(spark, [(0, "", "", [], "s", "", "", "1", ""), (1, "", "", [], "s", "", " ", "2", ""), (2, "r", "", [], "s", "", "", "3", ""), (3, "q", "r", [], "s", "", "", "4", "")])
    got = {r.seq: r.thread_key for r in threads.thread_keys(m).collect()}
    assert got[0] == got[1] == got[2] == "subj::" and got[3] == "r"


def test_selection(spark):
    body = "x" * 500
    rows = [(i, f"m{i}", "m0" if i else "", [], f"s{i}", "", "T", str(i), body) for i in range(4)] + [(9, "z", "", [], "q", "", "alone", "0", body)]
    chosen, kept = threads.select_threads(mails(spark, rows), least=2, most=3, target=1)
    r = chosen.first()
    assert (r.message_count, r.score, r.participants) == (3, 27.0, ["s0", "s1", "s2"]) and kept.count() == 3
    rows = [(i, f"m{i}", "m0" if i else "", [], "mary.lay.k@x", "", "T", str(i), body) for i in range(2)]
    assert threads.select_threads(mails(spark, rows), least=2, mailboxes=("lay-k",))[0].first().score == 2 * 3 + 5 + 2 + 40


# ── extraction ───────────────────────────────────────────────────────────────────────────────────────────────────
def test_rule_extraction_order(spark):
    m = mails(spark, [(1, "a", "", [], "jo.day@enron.com", "team@x.com, , sam@y.com", "Plan", "2001", "in a second LJM2 and the ceo said")]).withColumn("thread_id", F.lit("t"))
    found = extract.rule_claims(m)
    got = [(r.relation, r.object_name, r.object_type, r.confidence) for r in found.orderBy("msg", "rule", "hit").collect()]
    assert got == [
        ("sent_email", "Team", "Organisation", 1.0), ("sent_email", "Sam", "Person", 1.0), ("works_at", "Enron", "Organisation", 0.95), ("has_role", "ceo", "Role", 0.7),
        ("related_to", "LJM", "FinancialInstrument", 0.75), ("related_to", "LJM2", "FinancialInstrument", 0.75), ("related_to", "SEC", "Organisation", 0.75),
    ]
    assert {r.subject_name for r in found.collect()} == {"Jo Day"}
    role = found.where("relation = 'has_role'").first()
    assert role.char_offset_end == 28 + 50 and found.where("relation = 'sent_email'").first().char_offset_start is None
    ents = extract.rule_entities(m, found).orderBy("place").collect()
    assert (ents[0].name, ents[0].first_seen) == ("Enron", "") and ents[1].name == "Jo Day" and ents[0].last_seen == "2001"


def test_json_repair_and_normalisation(spark):
    fix = lambda t: one(spark, model_extract.repaired_json, t)
    assert fix('{"a": 1}') == '{"a": 1}' and fix('x\n```json\n{"a": 1}\n```') == '{"a": 1}' and fix('```\n{"a": 2}\n```') == '{"a": 2}'
    assert fix('so {"a": {"b": 1}} ok') == '{"a": {"b": 1}}' and fix('{"a": ') is None and fix(None) is None
    assert [one(spark, model_extract.entity_type, x) for x in ("org", " Person ", "gizmo", None)] == ["Organisation", "Person", "Project", "Project"]
    assert [one(spark, model_extract.relation, x) for x in ("Reports To", " has_value ", "likes", " reports to")] == ["reports_to", "has_value", "related_to", "related_to"]
    assert [one(spark, model_extract.confidence, x) for x in ("0.4", "0", None, "high", "1.2")] == [0.4, 0.7, 0.7, 0.7, 1.2]
    assert one(spark, model_extract.aliases, "Al") == ["Al"] and one(spark, model_extract.aliases, '["A","B"]') == ["A", "B"]


def test_model_extraction(spark):
    m = mails(spark, [(1, "a", "", [], "x@y", "", "S", "1", "The Deal was Signed"), (2, "b", "a", [], "z@y", "", "S", "2", "ok")]).withColumn("thread_id", F.lit("t"))
    replies = iter(["[]", "{}", '{"entities": [{"name": "Bob", "type": "org", "aliases": "B"}, {"name": " "}], "claims": [{"subject": "Bob", "relation": "decided", "object": "Deal", "confidence": 0, "quote": "the deal WAS", "email_id": "nope"}, {"subject": "", "object": "x"}, {"subject": "New", "relation": "x", "object": "Bob", "quote": "", "email_id": "e2"}]}'])
    prompts = model_extract.thread_prompts(m)
    assert "#2 id=e2 | z@y" in prompts.first().prompt
    replies = list(replies)
    raw = model_extract.ask(prompts, lambda p: replies[2], usable=lambda t: t not in ("{}", "[]"))
    parsed = model_extract.responses(raw)
    ents, found = model_extract.response_entities(parsed), model_extract.response_claims(parsed, m).orderBy("pos").collect()
    assert [(e.name, e.type, e.aliases) for e in ents.collect()] == [("Bob", "Organisation", ["B"])]
    assert (found[0].source_id, found[0].confidence, found[0].char_offset_start, found[0].char_offset_end, found[0].evidence_fallback) == ("e1", 0.7, 0, 12, True)
    assert (found[1].excerpt, found[1].char_offset_start, found[1].source_id, found[1].valid_from) == ("[Thread: S]", None, "e2", "1")
    all_ = {(e.name, e.type) for e in model_extract.named_entities(model_extract.response_claims(parsed, m), ents).collect()}
    assert all_ == {("Bob", "Organisation"), ("Deal", "Project"), ("New", "Person")}
    bad = spark.createDataFrame([("t", '{"claims": [{"subject": "a", "object": "b", "confidence": 1.2}]}'), ("u", "[1]"), ("v", "{}")], "thread_id string, raw string")
    assert model_extract.responses(bad).count() == 0
    assert model_extract.ask(prompts, None).first().raw is None


# ── deduplication ────────────────────────────────────────────────────────────────────────────────────────────────
def entities(spark, rows):
    return spark.createDataFrame([(i, f"n{i}", n, t, a, f, l, {}) for i, (n, t, a, f, l) in enumerate(rows)], schemas.ENTITY)


def test_exact_entity_merge(spark):
    df = entities(spark, [("Ann Lee", "Person", ["A"], "2", "3"), (" ann lee", "Person", ["A", "B"], "1", "5"), ("Ann Lee", "Organisation", [], "", ""), ("ANN LEE", "Person", [], "", "4")])
    got = dedup.exact_entities(df).orderBy("seq").collect()
    assert [(r.id, r.aliases, r.first_seen, r.last_seen) for r in got] == [("n0", ["A", "B", " ann lee", "ANN LEE"], "1", "5"), ("n2", [], "", "")]
    log = dedup.exact_merges(df).orderBy("loser_id").collect()
    assert [(r.winner_id, r.loser_id, r.reason) for r in log] == [("n0", "n1", "exact_match"), ("n0", "n3", "exact_match")]
    assert '"aliases":["A"]' in log[0].original_snapshots.winner and '"aliases":["A","B"," ann lee"]' in log[1].original_snapshots.winner


def test_union_root_follows_order(spark):
    pairs = lambda p: spark.createDataFrame([("T", *x, 0.9) for x in p], "type string, i long, j long, similarity double")
    roots, united = dedup.union_order(pairs([(0, 2), (1, 2)]))
    assert {(r.member, r.root) for r in roots.collect()} == {(0, 1), (1, 1), (2, 1)} and united.count() == 2
    roots, _ = dedup.union_order(pairs([(0, 1), (1, 2)]))
    assert {r.root for r in roots.collect()} == {0}


def test_semantic_merge(spark):
    df = entities(spark, [("aa", "Person", [], "", ""), ("bb", "Person", [], "", ""), ("cc", "Person", [], "", ""), ("dd", "Person", [], "", "")])
    c = F.col("name")
    vec = F.when(c == "aa", F.array(F.lit(1.0), F.lit(0.0))).when(c == "bb", F.array(F.lit(0.0), F.lit(1.0))).when(c == "cc", F.array(F.lit(0.7), F.lit(0.7))).otherwise(F.array(F.lit(-1.0), F.lit(0.0)))
    final, remap, log = dedup.canonical_entities(df, vec, 0.7)
    assert {(r.id, tuple(r.aliases)) for r in final.collect()} == {("n1", ("cc",)), ("n3", ())}
    assert {(r.id, r.root_id) for r in remap.collect()} == {("n0", "n1"), ("n1", "n1"), ("n2", "n1"), ("n3", "n3")}
    assert sorted((r.winner_id, r.loser_id, r.reason) for r in log.collect()) == [("n0", "n2", "semantic_similarity=0.707"), ("n1", "n2", "semantic_similarity=0.707")]


def test_claim_merge(spark):
    long = "x" * 100
    df = claims(spark, [
        (0, "s", "Ken", "has_value", "o", "5", 0.9, None, [("m1", long + "1")]), (1, "s", "ken ", "has_value", "o", "5", 0.6, "2001-01", [("m1", long + "2"), ("m2", "b")]),
        (2, "s", "Ken", "has_value", "o", "5", 0.7, "2001-01", [("m3", "c")]), (3, "s", "Kenneth", "has_value", "o", "5", 0.7, "2001-01", [("m3", "c")]),
    ])
    got = dedup.merged_claims(df).orderBy("seq").collect()
    assert [r.id for r in got] == ["c2", "c3"] and got[0].confidence == 0.9 and got[0].occurrences == 3
    assert [(e.source_id, e.excerpt[-1]) for e in got[0].evidence] == [("m3", "c"), ("m1", "1"), ("m2", "b")]
    log = dedup.claim_merges(df).collect()
    assert {r.loser_id for r in log} == {"c0", "c1"} and {r.reason for r in log} == {"same_canonical_key (3 occurrences)"}


def test_supersession_and_gate(spark):
    df = claims(spark, [(0, "s", "Jo", "has_role", "a", "Analyst", 0.9, "t1", []), (1, "s", "Jo", "has_status", "b", "Active", 0.9, "t2", []), (2, "s", "Joe", "has_role", "a", "Analyst", 0.4, "t3", []), (3, "s", "Jo", "related_to", "a", "Other", 0.5, "t0", [])])
    done = dedup.superseded(df)
    got = {r.id: r for r in done.collect()}
    assert (got["c0"].status, got["c0"].valid_until, got["c0"].superseded_by) == ("historical", "t2", "c1")
    assert (got["c1"].status, got["c1"].superseded_by) == ("historical", "c2") and got["c2"].status == got["c3"].status == "current"
    assert {r.id for r in dedup.confident(done).collect()} == {"c0", "c1", "c3"}
    assert dedup.supersessions(df, done).count() == 2


def test_artifacts_keep_all_rows(spark):
    df = spark.createDataFrame([("a", 0, "Same text"), ("b", 1, ""), ("c", 2, " same TEXT "), ("d", 3, "")], "source_id string, seq long, excerpt string")
    got = {r.source_id: (r.canonical_id, r.group_size) for r in dedup.artifact_groups(df).collect()}
    assert got == {"a": ("a", 2), "b": ("b", 1), "c": ("a", 2), "d": ("d", 1)}
    moved = dedup.resequenced(df.select("source_id"), dedup.artifact_groups(df)).orderBy("artifact_place").collect()
    assert [r.source_id for r in moved] == ["a", "c", "b", "d"]


def test_pair_blocks_equal_plain_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(vecs)], "seq long, type string, vec array<double>")
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2 and unit[i] @ unit[j] >= 0.8}
    for block in (2048, 7):
        got = dedup.cosine_pairs(df, 0.8, block=block).collect()
        assert {(r.i, r.j) for r in got} == want and len(got) == len(want)


def test_deduplicator_and_undo(spark):
    ents = entities(spark, [("Ann", "Person", [], "1", "1"), ("ann", "Person", [], "2", "2"), ("X", "Project", [], "", ""), ("lone", "Project", [], "", "")])
    df = claims(spark, [(0, "n0", "Ann", "decided", "n2", "X", 0.9, "1", [("m", "a")]), (1, "n1", "ann", "decided", "n2", "X", 0.8, "2", [("m", "b")])])
    store = dedup.Deduplicator(ents, df, HashedTrigrams(), similarity=0.99).run_full_pipeline().to_memory_store()
    assert {r.id for r in store.entities.collect()} == {"n0", "n2"} and [r.id for r in store.claims.collect()] == ["c1"]
    log = {r.reason: r.id for r in store.merge_log.collect()}
    assert store.undo_merge("nope") is False
    assert store.undo_merge(log["exact_match"]) is True
    assert {r.id for r in store.entities.collect()} == {"n0", "n1", "n2"} and store.claims.first().subject_id == "n1"
    assert store.undo_merge(log["same_canonical_key (2 occurrences)"]) is True
    assert {r.id: r.confidence for r in store.claims.collect()} == {"c0": 0.9, "c1": 0.8} and store.merge_log.count() == 0


# ── graph ────────────────────────────────────────────────────────────────────────────────────────────────────────
def small_graph(spark):
    nodes = spark.createDataFrame([("a", "A", "Person"), ("b", "B", "Person"), ("c", "C", "Event")], "id string, name string, type string")
    ev = [("m", "q")]
    return nodes, claims(spark, [(0, "a", "A", "manages", "b", "B", 0.9, "1", ev), (1, "a", "A", "owes", "b", "B", 0.9, "1", ev), (2, "b", "B", "created", "b", "B", 0.9, "1", ev), (3, "a", "A", "owes", "z", "Zed", 0.2, "1", [])])


def test_graph_statistics(spark):
    nodes, edges = graph.build_graph(*small_graph(spark))
    stats = graph.graph_stats(nodes, edges)
    assert (stats["total_nodes"], stats["total_edges"], stats["grounding_coverage"], stats["weak_components"]) == (4, 4, "75.0%", 2)
    assert {r.id: r.degree for r in graph.degrees(edges).collect()} == {"a": 3, "b": 4, "z": 1}
    assert nodes.where("id = 'z'").first().type == "Unknown" and stats["density"] == 4 / 12
    assert graph.node_link(nodes, edges).count() == 8
    assert {(r.id, r.hop) for r in graph.two_hops(edges, "z").collect()} == {("z", 0), ("a", 1), ("b", 2)}
    assert browse.merge_summary(dedup.exact_merges(entities(spark, []))).count() == 0


def test_components_on_chain_and_empty(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(chain).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100 and len(got) == 43
    assert connected_components(chain.limit(0)).count() == 0


# ── retrieval ────────────────────────────────────────────────────────────────────────────────────────────────────
def test_one_hop_is_not_symmetric(spark):
    df = claims(spark, [(0, "s", "s", "owes", "n", "n", 0.9, "1", []), (1, "n", "n", "owes", "m", "m", 0.9, "1", []), (2, "k", "k", "owes", "n", "n", 0.9, "1", [])])
    assert {r.id for r in retrieve.one_hop(df, spark.createDataFrame([("s",)], "id string")).collect()} == {"c0", "c1"}


def test_scores_and_evidence(spark):
    r = spark.createDataFrame([(0.5, 0.8, "current"), (0.5, 0.8, "historical"), (0.5, None, "current")], "s double, c double, st string")
    got = [x.v for x in r.select(retrieve.claim_score(F.col("s"), F.col("c"), F.col("st")).alias("v")).collect()]
    assert got == pytest.approx([0.66, 0.60, 0.60])
    df = claims(spark, [(0, "a", "A", "owes", "b", "B", 0.9, "1", [("m", "y" * 50 + "1"), ("m", "z")]), (1, "a", "A", "has_value", "b", "B", 0.8, "1", [("m", "y" * 50 + "2"), ("k", "y")])])
    vec = F.array(F.lit(1.0), F.lit(0.0))
    q = spark.createDataFrame([("why?",)], "question string").withColumn("qvec", vec)
    ents = spark.createDataFrame([("a", "A", "Person"), ("b", "B", "Person")], "id string, name string, type string").withColumn("vec", vec)
    ranked = retrieve.ranked_claims(df.withColumn("vec", vec), q, 20)
    snips = retrieve.evidence_snippets(ranked).orderBy("rank", "pos").collect()
    assert [(s.source_id, s.excerpt[-1], s.supporting_claim) for s in snips] == [("m", "1", "A —owes→ B"), ("m", "z", "A —owes→ B"), ("k", "y", "A —has_value→ B")]
    pack = retrieve.grounded_answers(retrieve.context_pack(q, ents, df.withColumn("vec", vec)), lambda p: None if "why" in p else "no").first()
    assert pack.context_summary.split("\n")[0] == "[✓] A —owes→ B (confidence: 0.90, evidence: 2 sources)"
    assert "1. [✓ Current] **A** —owes→ **B** (confidence: 90%, 2 evidence sources)" in pack.generated_answer


# ── sources, store, streams ──────────────────────────────────────────────────────────────────────────────────────
def test_maildir(spark, tmp_path):
    box = tmp_path / "lay-k" / "sent"
    box.mkdir(parents=True)
    other = tmp_path / "lay-k" / "misc"
    other.mkdir()
    body = "These are the figures that we talked about on Monday, with all the notes. " * 3
    head = "Message-ID: <1@x>\nIn-Reply-To: <0@x>\nReferences: <0@x> <9@x>\nFrom: ann@x.org\nTo: bob@x.org\nSubject: Plan\nDate: Mon, 5 Feb 2001 10:00:00 -0800\n\n"
    (box / "1").write_text(head + body)
    (box / "2").write_text("Subject: short\nX-Pad: " + "p" * 300 + "\n\nshort")
    (other / "3").write_text("Date: whenever\nMessage-ID: <3@x>\n\n" + body)
    (other / "4").write_text("tiny")
    got = mail.read_maildir(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.message_id, r.ts_raw) for r in got] == [("<1@x>", "2001-02-05T10:00:00-08:00"), ("<3@x>", "whenever")]
    assert got[0].refs == ["<0@x>", "<9@x>"] and got[0].sender == "ann@x.org" and len(got[0].email_id) == 12
    assert mail.mail_files(spark, str(tmp_path), most=1).count() == 1


def test_thread_json_and_resume(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"thread_id": "t", "subject": "S", "message_count": 1, "participants": ["a"], "messages": [{"email_id": "1", "from": "a", "timestamp": "2001", "body": "b"}]}, {"email_id": "9", "subject": "F", "from": "z", "body": "c"}]')
    threads_ = mail.read_threads(spark, str(tmp_path / "t.json"))
    assert {(r.thread_id, r.message_count) for r in threads_.collect()} == {("t", 1), ("flat_9", 1)}
    flat = mail.thread_messages(threads_)
    assert {r.sender for r in flat.collect()} == {"a", "z"}
    stage = mail.Stage(spark, str(tmp_path / "stage"), "thread_id")
    assert stage.todo(threads_).count() == 2
    threads_.select("thread_id", "subject").write.parquet(str(tmp_path / "stage" / "subjects" / "batch-killed"))  # a run that died before its keys
    stage.add(threads_.where("thread_id = 't'"), subjects=threads_.where("thread_id = 't'").select("thread_id", "subject"))
    assert [r.thread_id for r in stage.todo(threads_).collect()] == ["flat_9"]
    assert [r.subject for r in stage.read("subjects").collect()] == ["S"]
    assert threads.nested(flat.withColumn("refs", F.array().cast("array<string>"))).orderBy("thread_id").first().message_count == 1


def test_store_round_trip(spark, tmp_path):
    nodes, edges = small_graph(spark)
    ents = nodes.withColumn("aliases", F.array(F.lit("Al")))
    store = MemoryStore(ents, edges, spark.createDataFrame([], schemas.MERGE))
    assert store.find_entities_by_name("al").count() == 3 and store.find_entities_by_name("zz").count() == 0
    assert store.get_claims_between("b", "a").count() == 2 and store.get_claims_between("b", "b").count() == 1 and store.get_claims_for_entity("b").count() == 3
    assert store.remove_orphan_entities() == 1 and store.get_entity("c") is None
    store.add_entity(ents.where("id = 'a'").withColumn("name", F.lit("New"))).remove_claim("c3")
    back = MemoryStore.from_snapshot(spark, store.to_snapshot(str(tmp_path / "snap")))
    assert back.get_entity("a").name == "New" and back.claims.count() == 3


def test_stream_ingest_is_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"ts": "2024-01-01T00:00:00", "body": "x"}\n{"ts": "2024-01-01T00:01:00", "body": "x"}\n{"ts": "2024-01-01T00:02:00", "body": "y"}')
    run = lambda k: ingest.ingest(ingest.message_stream(spark, str(src), "ts timestamp, body string"), str(tmp_path / "out"), str(tmp_path / f"cp{k}")).awaitTermination()
    run(0)
    (src / "b.json").write_text('{"ts": "2024-01-01T00:03:00", "body": "y"}\n{"ts": "2024-01-01T00:04:00", "body": "z"}')
    run(0)
    run(1)
    assert sorted(r.body for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["x", "y", "z"]


def test_build_from_thread_files(spark, tmp_path):
    from memloom.pipeline import run

    sample = mail.sample_threads(spark)
    assert (sample.count(), sample.agg(F.sum("message_count")).first()[0]) == (15, 75) and mail.read_source(spark).count() == 75
    (tmp_path / "t.json").write_text("[" + ",".join(sample.limit(3).toJSON().collect()) + "]")
    source = mail.read_source(spark, threads=str(tmp_path / "t.json"))
    out = str(tmp_path / "build")
    stats = run(spark, source, out, questions=["who approved?"])
    assert stats["total_edges"] > 10 and stats["grounding_coverage"] == "100.0%"
    pack = spark.read.json(f"{out}/context_packs").first()
    assert pack.question == "who approved?" and "Relevant Facts" in pack.generated_answer
    again = run(spark, source, out, skip_extract=True)
    assert again["total_edges"] == stats["total_edges"]


def maildir(tmp_path, n=6):
    """Two threads of mails in files whose hashed numbers are large."""
    for t, who in (("Plan", "lay-k"), ("Deal", "skilling-j")):
        box = tmp_path / "mail" / who / "sent"
        box.mkdir(parents=True)
        for i in range(n):
            body = f"The board approved the $5M {t} and the CFO was concerned about Houston and Raptor, number {i}. " * 3
            reply = f"In-Reply-To: <{t}{i - 1}@x>\n" if i else ""
            (box / str(i)).write_text(f"Message-ID: <{t}{i}@x>\n{reply}From: p{i % 3}.x@enron.com\nTo: p{(i + 1) % 3}.x@enron.com\nSubject: {t}\nDate: Mon, {i + 1} Feb 2001 10:00:00 -0800\n\n{body}")
    return str(tmp_path / "mail")


def test_build_from_mail_files_goes_on_after_a_kill(spark, tmp_path):
    from memloom.operators.graph import load_node_link, load_stats
    from memloom.pipeline import run

    out = str(tmp_path / "build")
    messages = mail.read_maildir(spark, maildir(tmp_path))
    assert messages.agg(F.max("seq")).first()[0] > 1 << 50
    stage = mail.Stage(spark, f"{out}/extracted", "thread_id")
    chosen, _ = threads.select_threads(messages, least=2)
    one = chosen.limit(1).select("thread_id")
    ents, found = (spark.createDataFrame([], "thread_id string, place struct<msg:long,rule:int,hit:int>, " + kind.replace("seq long, ", "")) for kind in (schemas.ENTITY, schemas.CLAIM))
    stage.add(one, entities=ents, claims=found)  # a run before finished one thread, without any finding
    stats = run(spark, messages, out, questions=["who approved?", "what of Houston?"], least=2, wave=1)
    assert stage.read("done").count() == 2 and stage.read("entities").select("thread_id").distinct().count() == 1
    packs = {r.question: r for r in spark.read.json(f"{out}/context_packs").collect()}
    assert set(packs) == {"who approved?", "what of Houston?"} and all("Relevant Facts" in r.generated_answer for r in packs.values())
    assert load_stats(spark, f"{out}/graph_stats") == stats and load_stats(spark, f"{out}/nothing") == {}
    nodes, edges = load_node_link(spark, f"{out}/graph_json")
    assert (nodes.count(), edges.count()) == (stats["total_nodes"], stats["total_edges"])
    e, c = spark.read.parquet(f"{out}/deduped/entities"), spark.read.parquet(f"{out}/deduped/claims")
    log = spark.read.parquet(f"{out}/deduped/merge_log")
    assert tuple(graph.totals(e, c, log).first()) == (e.count(), c.count(), log.count())
    assert [r.value for r in browse.distinct_values(c, "status").collect()] == sorted({r.status for r in c.collect()})


def test_climbing_equals_replaying(spark):
    from memloom.operators.scratch import Scratch

    make = lambda pairs: spark.createDataFrame([(i, 0, c, p) for i, (c, p) in enumerate(pairs)], "seq long, ord int, child string, parent string")
    trees = make([(f"m{i}", f"m{i - 1}") for i in range(1, 12)] + [("x", "m3"), ("y", "x"), ("b", "a"), ("s", "s"), ("b", "a")])
    got = [{(r.mid, r.root) for r in f(trees, Scratch(spark, "t")).collect()} for f in (threads.climbed, threads.replayed)]
    assert got[0] == got[1] and ("y", "m0") in got[0] and ("b", "a") in got[0]
    assert threads.climbed(make([("a", "b"), ("a", "c")]), Scratch(spark, "t")) is None and threads.climbed(make([("a", "b"), ("b", "a")]), Scratch(spark, "t")) is None


def test_artifact_order_decides_winners(spark):
    """The third thread opens like the first, so its entity comes before the second thread's and wins the merge."""
    ents = spark.createDataFrame([("t2", 1, "i2", "ANN "), ("t3", 1, "i3", "Ann"), ("t1", 1, "i1", "Bob")], "thread_id string, place int, id string, name string")
    ents = ents.select("*", F.lit("Person").alias("type"), F.array().cast("array<string>").alias("aliases"), F.lit("1").alias("first_seen"), F.lit("1").alias("last_seen"), F.map_from_arrays(F.array(F.lit("k")), F.array(F.lit("v"))).alias("metadata"))
    found = claims(spark, [(0, "i1", "Bob", "owes", "i3", "Ann", 0.9, "1", [("m", "x")]), (1, "i2", "ANN ", "manages", "i1", "Bob", 0.9, "1", [("m", "x")])]).drop("seq")
    found = found.select("*", F.when(F.col("relation") == "owes", "t1").otherwise("t2").alias("thread_id"), F.lit(1).alias("place"))
    artifacts = spark.createDataFrame([("t1", 1, "Same"), ("t2", 2, "Other"), ("t3", 3, " same")], "source_id string, seq long, excerpt string")
    one = lambda c: F.when(F.lower(F.trim(c)) == "bob", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    done = dedup.Deduplicator(ents, found, one, artifacts=artifacts).run_full_pipeline()
    assert {r.id for r in done.entities.collect()} == {"i1", "i3"}
    assert {(r.subject_id, r.object_id) for r in done.claims.collect()} == {("i1", "i3"), ("i3", "i1")}


def test_search_answers(spark):
    q = spark.createDataFrame([("q",)], "question string").withColumn("qvec", F.array(F.lit(1.0)))
    ents = spark.createDataFrame([("a", "A", "Person")], "id string, name string, type string").withColumn("vec", F.array(F.lit(1.0)))
    df = claims(spark, [(0, "a", "A", "works_at", "b", "B", 0.8, "1", [("m", "seen it")])]).withColumn("vec", F.array(F.lit(0.5)))
    found = retrieve.searched(retrieve.mixed_search(ents, df, q), ents, df)
    assert retrieve.search_answer(found).first().answer == "• **A** (Person)\n• A **works at** B  *(confidence: 80%, 1 evidence)*"
    assert '"seen it" from' in retrieve.search_prompt(found, "who?").first().prompt
    assert retrieve.search_reply(found, "who?", None) is None and retrieve.search_reply(found, "who?", lambda p: "fine") == "fine"
    assert retrieve.search_reply(found, "who?", lambda p: 1 / 0).startswith("model error")


def test_questions_have_windows_of_their_own(spark):
    vec = lambda x, y: F.array(F.lit(x), F.lit(y))
    ents = spark.createDataFrame([(f"e{i}", f"E{i}", "Person", [float(i), 5.0 - i]) for i in range(6)], "id string, name string, type string, vec array<double>")
    df = claims(spark, [(i, f"e{i}", f"E{i}", "owes", f"e{(i + 1) % 6}", f"E{(i + 1) % 6}", 0.9, "1", [("m", f"x{i}")]) for i in range(6)]).withColumn("vec", vec(1.0, 0.0))
    both = spark.createDataFrame([(1, "x?", [1.0, 0.0]), (2, "y?", [0.0, 1.0])], "question_id long, question string, qvec array<double>")
    packs = {r.question_id: r for r in retrieve.context_packs(both, ents, df, k=2).collect()}
    for r in both.collect():
        alone = retrieve.context_pack(both.where(f"question_id = {r.question_id}").drop("question_id"), ents, df, k=2).first()
        assert all(getattr(alone, c) == getattr(packs[r.question_id], c) for c in ("matched_entities", "relevant_claims", "evidence_snippets", "context_summary"))


def test_retraction_and_acl(spark):
    df = claims(spark, [(0, "a", "A", "owes", "b", "B", 0.9, "1", [("m", "x"), ("k", "y")]), (1, "a", "A", "owes", "c", "C", 0.9, "1", [("m", "x")]), (2, "a", "A", "owes", "d", "D", 0.9, "1", [])])
    out = {r.id: (r.status, [e.source_id for e in r.evidence]) for r in ingest.retract_source(df, spark.createDataFrame([("m",)], "source_id string")).collect()}
    assert out == {"c0": ("current", ["k"]), "c1": ("retracted", []), "c2": ("current", [])}
    acl = spark.createDataFrame([("ann", "k")], "principal string, source_id string")
    assert [r.id for r in ingest.visible_claims(df, acl, "ann").collect()] == ["c0"]
    assert [r.id for r in ingest.durable_claims(df).collect()] == ["c0"]


def test_model_claims_come_before_rules(spark):
    from memloom.pipeline import extraction_tables

    m = mails(spark, [(1, "a", "", [], "jo.day@x.org", "sam@y.com", "Plan", "2001", "the CFO said so")]).withColumn("thread_id", F.lit("t"))
    reply = '{"entities": [{"name": "Jo Day", "type": "Person"}, {"name": "CFO", "type": "role"}], "claims": [{"subject": "Jo Day", "relation": "has_role", "object": "cfo", "confidence": 0.9, "quote": "the CFO", "email_id": "e1"}]}'
    ents, found = extraction_tables(m, lambda prompt: reply)
    got = [(r.relation, r.object_name, r.confidence) for r in found.orderBy("seq").collect()]
    assert got == [("has_role", "cfo", 0.9), ("sent_email", "Sam", 1.0)]
    assert {(r.name, r.type) for r in ents.collect()} == {("Enron", "Organisation"), ("Jo Day", "Person"), ("cfo", "Role"), ("Sam", "Person")}
    ents, found = extraction_tables(m)
    assert [r.relation for r in found.orderBy("seq").collect()] == ["sent_email", "has_role"]
