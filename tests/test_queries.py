"""Every catalogue query against its DuckDB statement on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from memloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def cell(x):
    return float(f"{x:.9g}") if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    cur = con.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr(tuple(cell(dict(zip(cols, r))[c]) for c in sorted(cols))) for r in cur.fetchall())
    assert sorted(repr(tuple(cell(r[c]) for c in sorted(cols))) for r in rows) == want


def test_undo_covers_all_users(spark, tmp_path):
    """Merging, logging and undoing run over every user's claims, here without a user 1."""
    from datetime import datetime, timedelta

    from memloom.plans.queries import undone_last_merge

    rows = [(i, i // 3, 2 + i % 3, "ab"[i % 5 % 2], 7.0 * (i * 11 % 13)) for i in range(24)]
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, start + timedelta(hours=h), u, t, v, "{}") for i, h, u, t, v in rows], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.write.parquet(f"{tmp_path}/events.parquet")
    groups = {}
    for i, _, u, t, v in rows:  # by time and number
        groups.setdefault((u, t), []).append((i, min(1.0, v / 100)))
    lost = {i: g for g in groups.values() for i, _ in g[:-1]}
    last = max(lost)
    want = {f"k{g[-1][0]}": max(c for _, c in g) for g in groups.values()}
    group = lost[last]
    want[f"k{group[-1][0]}"] = max([group[-1][1], *(c for i, c in group if i < last)])
    want[f"k{last}"] = dict(group)[last]
    store, log, one, undone = undone_last_merge(spark, str(tmp_path))
    assert undone and one.loser_id == f"k{last}" and {r.loser_id for r in log.collect()} == {f"k{i}" for i in lost}
    assert {r.id: round(r.confidence, 9) for r in store.claims.collect()} == {k: round(c, 9) for k, c in want.items()}
    assert {r.loser_id for r in store.merge_log.collect()} == {f"k{i}" for i in lost if i != last}
    assert [tuple(r) for r in QUERIES["undo_merge_roundtrip"](spark, str(tmp_path)).collect()] == [(True, 2, -1)]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_one_sided_plans(spark):
    """Question and seeds are broadcast; lexicon rules have no join; scans read only the columns they need."""
    from memloom.operators import extract
    from memloom.plans.adapters import messages, table

    m = messages(spark, SF)
    plan = extract.known_names(m)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") <= m._jdf.queryExecution().executedPlan().toString().count("Join") and "Python" not in plan
    gate = QUERIES["msg_min_body_gate"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in gate and "BroadcastHashJoin" in gate
    scan = table(spark, SF, "events").where("value > 1").select("value")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<value:double>" in scan and "GreaterThan(value,1.0)" in scan
