"""Sections: written in order, read a match at a time, after post-processors."""

from pyspark.sql import functions as F

from arenalake.sources import sections


def test_a_match_is_read_alone(spark, tmp_path):
    rows = spark.createDataFrame([(m, f"n{(i * 7) % 5}", i) for m in range(4) for i in range(5)], "match_id int, name string, v int").repartition(3)
    sections.write({"nodes": rows}, str(tmp_path))
    one = sections.read(spark, str(tmp_path), "nodes", 2)
    assert [r.name for r in one.collect()] == ["n0", "n1", "n2", "n3", "n4"]  # as written
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(match_id" in plan and "(match_id" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert all("match_id=2" in r[0] for r in one.select(F.input_file_name()).distinct().collect())
    assert sections.read(spark, str(tmp_path), "nodes").count() == 20


def test_merged_lists_keep_the_first_side_first(spark):
    a = spark.createDataFrame([(1, 10, 1, "x"), (1, 20, 2, "y")], "match_id int, t_ms int, seq long, who string")
    b = spark.createDataFrame([(1, 10, 1, 5), (1, 5, 0, 6)], "match_id int, t_ms int, seq long, amount int")
    got = [(r.t_ms, r.side, r.who, r.amount) for r in sections.merged(a, b).orderBy("match_id", "t_ms", "seq", "side").collect()]
    assert got == [(5, 1, None, 6), (10, 0, "x", None), (10, 1, None, 5), (20, 0, "y", None)]


def test_post_processors_see_what_came_before(spark):
    t = {"a": spark.range(3), "b": spark.range(1)}
    steps = [lambda x: {"a": x["a"].filter("id > 0")}, lambda x: {"c": x["a"].selectExpr("id * 10 AS id")}]
    out = sections.processed(t, steps)
    assert {k: sorted(r.id for r in v.collect()) for k, v in out.items()} == {"a": [1, 2], "b": [0], "c": [10, 20]} and set(t) == {"a", "b"}


def test_other_matches_are_not_listed(spark, tmp_path):
    rows = spark.createDataFrame([(m, "n", m) for m in range(6)], "match_id int, name string, v int")
    sections.write({"nodes": rows}, str(tmp_path))
    assert sections.read(spark, str(tmp_path), "nodes", 9).count() == 0
    (tmp_path / "nodes" / "stray").mkdir()
    (tmp_path / "nodes" / "stray" / "x.parquet").write_text("no section: who lists the whole folder fails")
    assert [r.v for r in sections.read(spark, str(tmp_path), "nodes", 4).collect()] == [4]
