import collections
import hashlib

import cases
import corpus_pipeline
import duckdb
import pytest

from aestudy.llm import quality_gbt, secret_scan
from aestudy.sources.checkpoints import scratch_path
from test_exact_and_near import brute_labels
from test_rules_and_models import SF


def through(spark, docs, sf_dir=SF):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        folder = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        out.append(docs)
    return out


def word_set(text, words):
    parts = text.encode().lower().split()
    return {b" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)} or ({b" ".join(parts)} if parts else set())


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good, exact, near, clean, packed = through(spark, docs)
    model = quality_gbt.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    expected = {i for i, t in rows.items() if model.score(quality_gbt.np.array([quality_gbt.statistics(t.encode())]))[0] >= 0.3}
    assert {r["doc_id"] for r in good.collect()} == expected
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    assert not [i for i, q in labels.items() if q == 1 and i not in expected]

    last = collections.defaultdict(int)
    for i in expected:
        last[rows[i]] = max(last[rows[i]], i)
    expected = set(last.values())
    assert {r["doc_id"] for r in exact.collect()} == expected

    # All pairs of the table by their exact similarity; fingerprints may miss one pair in a hundred of them.
    own = sorted(expected)
    sets = [word_set(rows[i], 5) for i in own]
    links = [(a, b) for a in range(len(own)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    kept = {r["doc_id"] for r in near.collect()}
    place = {i: k for k, i in enumerate(own)}
    apart = [(a, b) for a, b in links if own[a] in kept and own[b] in kept]
    assert len(apart) <= len(links) // 100
    linked = collections.defaultdict(set)
    for a, b in links:
        linked[a].add(b)
        linked[b].add(a)
    for i in expected - kept:  # nothing goes that isn't reachable from a smaller one
        seen, todo = set(), [place[i]]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                todo += linked[k]
        assert any(own[k] in kept and own[k] < i for k in seen)
    if not apart:
        assert kept == set(brute_labels(own, lambda a, b: b in linked[a]))
    expected = kept

    net = secret_scan.fit_network(near)
    for r in clean.collect():
        spans = secret_scan.find_spans([rows[r["doc_id"]]], net)[0]
        assert r["text"] == secret_scan.redacted(rows[r["doc_id"]], spans, "[SECRET]") and r["n_chars"] == len(r["text"])
    assert clean.count() == len(expected) and clean.columns == docs.columns
    assert {r["doc_id"] for r in packed.collect()} == expected


def test_run_gives_the_last_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    last = through(spark, docs)[-1]
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select(columns).collect())) == sorted(map(tuple, last.select(columns).collect()))


@pytest.mark.parametrize("make", [cases.frame, cases.empty])
def test_odd_rows_pass_all_stages(spark, make):
    docs = make(spark)
    stages = through(spark, docs)
    assert all(s.columns == docs.columns for s in stages[:-1])
    texts = [hashlib.sha256((r["text"] or "").encode()).digest() for r in stages[1].collect()]
    assert len(texts) == len(set(texts))
