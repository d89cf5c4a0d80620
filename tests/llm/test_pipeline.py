"""The pipeline's stages against brute force on the smallest table, and the registration."""

import re
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_in_order(spark):
    import corpus_pipeline
    from haulcast.llm.common import stage

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, step in corpus_pipeline.STAGES:
        out.append(stage(step(spark, out[-1], SF)))
    known, once, unlike, mixed, packed = out[1:]
    assert all(x.columns == docs.columns for x in (known, once, unlike, mixed))
    assert known.count() >= 0.98 * docs.count()
    last = {}
    for r in known.collect():
        last[r["text"]] = max(r["doc_id"], last.get(r["text"], -1))
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(last.values())

    def grams(text):
        w = WORD.findall(text.lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = {r["doc_id"]: grams(r["text"]) for r in once.collect()}
    gone = {b for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    kept = {r["doc_id"] for r in unlike.collect()}
    assert kept <= set(sets) and set(sets) - kept == gone
    words = sum(len(WORD.findall(r["text"])) for r in unlike.collect())
    assert abs(sum(len(WORD.findall(r["text"])) for r in mixed.collect()) - words) <= 0.02 * words
    ends = packed.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert all(r["sum(length)"] <= 2048 for r in ends)


def test_odd_rows_pass_all_stages(spark):
    import corpus_pipeline
    from haulcast.llm.common import stage

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(40).selectExpr("if(doc_id % 2 = 0, null, 7L) as doc_id", "if(doc_id % 5 = 0, null, text) as text", "if(doc_id % 3 = 0, null, lang) as lang", "source", "n_chars")
    rows = docs.unionByName(odd).selectExpr("*", "1 as _word", "doc_id as row", "text as part", "source as d")
    out = rows
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = stage(step(spark, out, SF))
        assert out.columns == rows.columns and out.count() > 0
    none = rows.limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, none, SF).count() == 0


def test_registered_once_each():
    from __spark_entry__ import queries

    names = [n for n in queries() if n == "pipeline" or re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names
