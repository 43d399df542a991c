"""The pipeline against what its stages must do, on the smallest tables."""

import sys

import compare
from test_operators import base_pii, jaccard_model

import __spark_entry__
import corpus_pipeline
from arenalake.llm import decontaminate, quality


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    left = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, sf).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        left.append(docs.count())
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            verdicts = {r.doc_id: r.kept for r in quality.judge(before).collect()}
            assert {r.doc_id for r in docs.collect()} == {i for i, kept in verdicts.items() if kept}
        if k == 1:
            want = jaccard_model([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, least) in want.items() if i == least}
        if k == 2:
            verdicts = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in decontaminate.judge(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert {r.doc_id for r in docs.collect()} == {i for i, (*_, bad) in verdicts.items() if not bad}
            left_over = decontaminate.judge(docs, spark.createDataFrame([], "item_id long, text string")).collect()
            assert all(r.n_words == verdicts[r.doc_id][0] - verdicts[r.doc_id][1] for r in left_over)
        if k == 3:
            texts = {r.doc_id: r.text for r in before.collect()}
            for r in docs.collect():
                own = {kind for kind, *_ in base_pii(texts[r.doc_id])}
                assert all(f"[{kind.upper()}]" in r.text for kind in own) or not own
                assert own or len(list(base_pii(r.text))) == 0
    assert left == sorted(left, reverse=True) and left[-1] > 0
    sizes = {r.source: (r.target, r.taken) for r in docs.groupBy("source", "target").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "taken").collect()}
    assert all(abs(taken - target) <= 0.05 * target + 130 for target, taken in sizes.values())
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, docs.collect()))


def test_queries_and_sql(spark, sf):
    con = compare.connect(sf)
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert {f"op{n}_" for n in range(1, 11)} <= {q.split("_")[0] + "_" for q in queries} and "pipeline" in queries and set(sql) <= set(queries)
    for name in ("op2_quality", "op6_decontaminate"):
        assert compare.differences(queries[name](spark, sf), con, sql[name]) is None
    assert sys.modules["corpus_pipeline"].ORACLE_SQL is None
