"""The pipeline against a plain version of its stages on the smallest tables."""

from __future__ import annotations

import re

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_version(spark):
    from memloom.llm import toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.scored(docs, model).where("predicted = 0").collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id in clean}
    best: dict[str, tuple[int, int]] = {}
    for d, t in texts.items():
        key = re.sub("[ \t-\r]", "", t)
        best[key] = max(best.get(key, (-1, 0)), (len(t), -d))
    left = sorted(-d for _, d in best.values())
    grams = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := re.findall("[^ \t-\r]+", texts[d].lower())) else set() for d in left}
    root = {d: d for d in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in left:
        for b in left:
            if a < b and grams[a] and 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    left = [d for d in left if find(d) == d]
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text or "")
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    left = [d for d in left if not any(tuple(words(texts[d])[i : i + 10]) in windows for i in range(len(words(texts[d]))))]
    packed = corpus_pipeline.run(spark, SF).collect()
    assert sorted({r.doc_id for r in packed}) == left
    assert [n for n, _ in corpus_pipeline.STAGES] and max(r.offset + r.length for r in packed) <= 1024


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_odd_input(spark, odd_docs, no_docs, name, stage):
    """Nulls, empty and long texts, repeats, clashing columns, a row without an id, and no rows at all."""
    nameless = spark.createDataFrame([(None, "a text of its own", "s", 1, "k", 0)], odd_docs.schema)
    out = stage(spark, odd_docs.unionByName(nameless), SF)
    if name == "best_fit_packing":
        assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {None, *range(1, 10)}
    else:
        kept = out.collect()
        assert out.columns == odd_docs.columns and {r.doc_id for r in kept} <= {None, *range(1, 10)}
        if name == "exact_dedup":
            assert sorted(((r.doc_id or 0) for r in kept)) == [0, 3, 4, 5, 6, 7, 8]
        if name == "minhash_near_dedup":
            assert {r.doc_id for r in kept} == {None, 1, 2, 3, 4, 6, 8, 9}
        if name == "benchmark_decontamination":
            assert len(kept) == 11
    assert stage(spark, no_docs, SF).count() == 0
