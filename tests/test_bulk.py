"""Bulk runs: outputs by match, errors beside them, and nothing done twice."""

import json

import pytest
from pyspark.sql import functions as F

from arenalake.sources import bulk


def line(kind, time, **data):
    return json.dumps({"kind": kind, "time": time, "data": data})


@pytest.fixture
def folder(tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.jsonl").write_text("\n".join([line("frag", 1.5, killer="x", at=[1, 2]), line("frag", 2.0, killer="y"), line("chat", 3)]))
    (src / "b.jsonl").write_text("\r\n".join([line("frag", 1, killer="x"), '{"time": 4}', '{"kind": "frag"}', "[1]", line("frag", 9, killer="lost")]))
    (src / "c.jsonl").write_text("\x00\x01 not a dump\nat all")
    (src / "d.jsonl").write_text("\n")
    (src / "e.jsonl").write_text(line("bad", 0) + "\n" + line("frag", 5, killer="z"))
    return src


def kinds(events):
    return events.groupBy("match_id").agg(F.count("*").alias("n"), F.max("t_ms").alias("last_ms"))


def killers(events):
    checked = F.when(F.col("kind") == "bad", F.raise_error(F.lit("no such kind"))).otherwise(F.try_variant_get("data", "$.killer", "string"))
    return events.groupBy("match_id").agg(F.array_join(F.array_sort(F.collect_list(checked)), ",").alias("killers"))


def read(spark, path):
    return spark.read.json(str(path))


def test_results_errors_and_counts(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    counts = bulk.run_folder(spark, str(folder), out, {"kinds": kinds, "killers": killers}, files_per_batch=3)
    assert counts == bulk.Counts(processed=3, failed=2, errors=6)
    assert {(r.match_id, r.n, r.last_ms) for r in read(spark, f"{out}/kinds").collect()} == {("a", 3, 3000), ("b", 1, 1000), ("e", 2, 5000)}
    # one analyzer fails on one match: the other matches, and the other analyzer, have their results
    assert {(r.match_id, r.killers) for r in read(spark, f"{out}/killers").collect()} == {("a", "x,y"), ("b", "x")}
    errors = {(r.match_id, r.analyzer, r.line if r.line is not None else -1, r.reason.split(" SQLSTATE")[0][-12:]) for r in read(spark, f"{out}/errors").collect()}
    assert {e for e in errors if e[1] == "reader"} == {("b", "reader", 1, "no kind"), ("b", "reader", 2, "no time"), ("b", "reader", 3, "unreadable"), ("c", "reader", 0, "unreadable"), ("c", "reader", 1, "unreadable")}
    assert [(e[0], e[1], e[2]) for e in errors if e[1] != "reader"] == [("e", "killers", -1)]
    files = {(r.match_id, r.status, r.events, r.bad_lines) for r in read(spark, f"{out}/files").collect()}
    assert files == {("a", "processed", 3, 0), ("b", "processed", 1, 3), ("c", "failed", 0, 2), ("d", "failed", 0, 0), ("e", "processed", 2, 0)}


def test_runs_go_on(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    bulk.run_folder(spark, str(folder), out, {"kinds": kinds})
    assert bulk.run_folder(spark, str(folder), out, {"kinds": kinds}) == bulk.Counts(0, 0, 0)
    (folder / "f.jsonl").write_text(line("frag", 7) + "\n" + json.dumps({"match_id": "g", "kind": "frag", "time": 8}))
    assert bulk.run_folder(spark, str(folder), out, {"kinds": kinds}) == bulk.Counts(1, 0, 0)
    assert {(r.match_id, r.n) for r in read(spark, f"{out}/kinds").collect()} == {("a", 3), ("b", 1), ("e", 2), ("f", 1), ("g", 1)}


def test_all_fail(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.jsonl").write_text(line("bad", 1))
    (src / "b.jsonl").write_text("nothing")
    assert bulk.run_folder(spark, str(src), out, {"killers": killers}) == bulk.Counts(1, 1, 2)
    assert spark.read.schema("match_id string, killers string").json(f"{out}/killers").count() == 0


def test_errors_as_rows(spark, tmp_path):
    """An analyzer that gives its errors as rows runs once, however many matches fail; their other rows are not kept."""
    src, out, calls = tmp_path / "in", str(tmp_path / "out"), []
    src.mkdir()
    for i in range(20):
        (src / f"m{i}.jsonl").write_text("\n".join([line("frag", 1, killer="x")] + [line("bad", 2)] * (i % 4 > 0)))

    def by_kind(events):
        calls.append(1)
        return events.groupBy("match_id", "kind").agg(F.count("*").alias("n")).withColumn("error", F.when(F.col("kind") == "bad", "no such kind"))

    assert bulk.run_folder(spark, str(src), out, {"by_kind": by_kind}) == bulk.Counts(20, 0, 15)
    assert sorted(r.match_id for r in read(spark, f"{out}/by_kind").collect()) == ["m0", "m12", "m16", "m4", "m8"] and len(calls) == 1
    assert "error" not in read(spark, f"{out}/by_kind").columns
    assert {(r.analyzer, r.reason) for r in read(spark, f"{out}/errors").collect()} == {("by_kind", "no such kind")}
