from __future__ import annotations

import json

from prepaudit.operators import cases
from prepaudit.sources import corpora, runstore, tables


def test_csv_in_and_out(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text("age,job\n 39, clerk\n 50, ?\n,x\n")
    df = tables.csv(spark, str(path), "age int, job string", placeholders=["?"], trim_left=True)
    assert [tuple(r) for r in df.collect()] == [(39, "clerk"), (50, None), (None, "x")]
    assert tables.csv(spark, str(path), trim_left=True).dtypes[0] == ("age", "int")
    tables.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3


def test_result_map_in_and_out(spark, tmp_path):
    path = tmp_path / "stats.json"
    path.write_text(json.dumps({"a": {"fixed": True, "n": 1}, "b": {"fixed": False, "n": 2}}, indent=2))
    df = tables.json_map(spark, str(path), "fixed: boolean, n: int", "issue")
    assert sorted(tuple(r) for r in df.collect()) == [("a", True, 1), ("b", False, 2)]
    tables.write_json(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_log_appends(spark, tmp_path):
    for _ in range(2):
        tables.append(spark.range(3), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6


def test_case_folders(spark, tmp_path):
    for case, files in {"one": {"in.py": "a\nb", "out.py": "c", "notes.md": "d"}, "two": {"in.py": "e"}}.items():
        (tmp_path / case).mkdir()
        for name, content in files.items():
            (tmp_path / case / name).write_text(content)
    texts = corpora.texts(spark, str(tmp_path))
    assert texts.count() == 4
    scripts = cases.excluding(corpora.texts(spark, str(tmp_path), "*.py"), "out")
    assert sorted((r["case"], r["file"]) for r in scripts.collect()) == [("one", "in.py"), ("two", "in.py")]
    roles = corpora.with_roles(texts, {"in.py": "original", "out.py": "fixed"})
    assert [tuple(r) for r in cases.complete_cases(roles, ["original", "fixed"]).collect()] == [("one", "a\nb", "c")]


def test_run_store_scan_and_append(spark, tmp_path):
    run = tmp_path / "store" / "exp" / "r1"
    for folder in ("metrics", "params"):
        (run / folder).mkdir(parents=True)
    (run / "meta.yaml").write_text("run_id: r1\nexperiment_id: 'exp'\nrun_name: a: b\nstart_time: 1000\nend_time: null\nstatus: 3\nuser_id: me\n")
    (run / "metrics" / "accuracy").write_text("1700 0.5 0\n1800 0.75 1\n")
    (run / "params" / "k").write_text("5\n")
    store = str(tmp_path / "store")
    assert [tuple(r) for r in runstore.scan_runs(spark, store).collect()] == [("r1", "exp", "a: b", 1000, None, 3)]
    assert sorted(tuple(r) for r in runstore.scan_metrics(spark, store).collect()) == [
        ("r1", "accuracy", 1700, 0.5, 0), ("r1", "accuracy", 1800, 0.75, 1)]
    assert [tuple(r) for r in runstore.scan_params(spark, store).collect()] == [("r1", "k", "5")]
    kept = str(tmp_path / "kept")
    for _ in range(2):
        runstore.append_records(runstore.scan_metrics(spark, store), kept, "run_metrics")
    assert runstore.read_records(spark, kept, "run_metrics").count() == 4


def test_one_large_map_is_read_by_many_tasks(spark, tmp_path):
    entries = {f"k{i}": {"name": f'a "quoted", {{braced}}\n  "k": line {i}', "n": i, "more": {"x": [1, 2]}} for i in range(20_000)}
    path = tmp_path / "large.json"
    path.write_text(json.dumps(entries, indent=2))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200_000)
    try:
        df = tables.json_map(spark, str(path), "name: string, n: int")
        assert df.rdd.getNumPartitions() > 4
        assert {r["key"]: (r["name"], r["n"]) for r in df.collect()} == {k: (v["name"], v["n"]) for k, v in entries.items()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for text, found in (("{}", 0), ('{"a": {"n": 1}, "b": {"n": 2}}', 2), ('{\n  "a": {\n    "n": 1\n  }\n}\n', 1)):
        path.write_text(text)
        assert tables.json_map(spark, str(path), "n: int").count() == found


def test_maps_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, f'n "{i}"\n', i / 3) for i in range(50)], "id int, name string, x double").repartition(3)
    tables.write_json_map(df, str(tmp_path / "maps"), "id")
    back = tables.json_map(spark, str(tmp_path / "maps"), "name: string, x: double", "id")
    assert sorted((int(r["id"]), r["name"], r["x"]) for r in back.collect()) == sorted(tuple(r) for r in df.collect())
