"""The training-data queries next to their DuckDB SQL, and the pipeline's stages, at sf0.01."""

import brute
import corpus_pipeline
import pytest
from oracle_check import compare, duck

from sensorlake.llm.oracle import SQL
from sensorlake.llm.queries import QUERIES


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, sf001, key):
    ok, message = compare(QUERIES[key](spark, sf001).toPandas(), duck(sf001).execute(SQL[key]).df())
    assert ok, message


def test_near_query_brute(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet").orderBy("doc_id").collect()
    sets = [brute.shingle_set(r.text) for r in docs]
    want = {(r.doc_id, len(s), docs[x].doc_id) for r, s, x in zip(docs, sets, brute.components(sets))}
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op6_near_dedup"](spark, sf001).collect()} == want


def test_personal_query_brute(spark, sf001):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()}
    for r in QUERIES["op10_personal_data"](spark, sf001).collect():
        base = brute.personal(text[r.doc_id])
        assert r.base_sha256 == brute.sha(brute.listed(base)) and set(brute.listed(base).split(",")) <= set(r.spans.split(","))


def test_pipeline_stages(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "line_dedup", "near_dedup", "decontaminate", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf001)
        docs = corpus_pipeline.written(docs, name)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
    before = spark.read.parquet(f"{sf001}/documents.parquet").collect()
    assert set(kept["language"]) == {r.doc_id for r in before if any(c.isalpha() for c in r.text)}
    expected = brute.cleaned([(r.doc_id, r.text) for r in kept["language"].values()], 10)
    for d, r in kept["line_dedup"].items():
        old = kept["language"][d].text
        clean = expected[d, old][1]
        assert r.text == (old if clean is None else clean)
    rows = sorted(kept["line_dedup"].values(), key=lambda r: r.doc_id)
    root = brute.components([brute.shingle_set(r.text) for r in rows], 80)
    assert set(kept["near_dedup"]) == {r.doc_id for r, x in zip(rows, root) if rows[x].doc_id == r.doc_id}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf001}/benchmark.parquet").collect()]
    for d, r in kept["near_dedup"].items():
        n, hit, _ = brute.contamination(r.text, items)
        assert (d in kept["decontaminate"]) == (len(hit) <= 0.8 * n)
        if d in kept["decontaminate"] and hit:
            words = brute.alnum_words(r.text)
            assert brute.alnum_words(kept["decontaminate"][d].text) == [w for k, w in enumerate(words) if k not in hit]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf001).groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in pieces} == set(kept["decontaminate"])
