from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepaudit.operators import distributed as d
from prepaudit.operators.neighbours import nearest


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows in one group, one null group, many small ones."""
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot", None, f"g{i % 40}"]), float(rng.randint(0, 50)), rng.random()) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, g string, x double, y double").repartition(8), rows


def test_running_total_matches_a_plain_loop(hot):
    df, rows = hot
    expected, sums = {}, defaultdict(lambda: [0, 0.0])
    for i, g, x, _ in rows:
        sums[g][0] += 1
        sums[g][1] += x
        expected[i] = (sums[g][0], sums[g][1])
    got = {r["id"]: (r["n"], r["s"]) for r in d.running_total(df, "g", ["id"], n=F.lit(1), s="x").collect()}
    assert got == expected


def test_no_slice_holds_the_hot_group(hot, monkeypatch):
    df, rows = hot
    settled = []
    monkeypatch.setattr(d, "settle", lambda frame, keep=d.settle: settled.append(keep(frame)) or settled[-1])
    df.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        d.running_total(df.withColumn("g", F.lit("all")), "g", ["id"], n=F.lit(1)).count()
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in settled[0].groupBy("__slice").count().collect()]
    assert len(sizes) == 8 and max(sizes) < len(rows) / 4


def test_running_total_without_groups(hot):
    df, rows = hot
    got = sorted(r["n"] for r in d.running_total(df, [], ["id"], n=F.lit(1)).collect())
    assert got == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("find", [d.quantiles, d.quantiles_by_counting])
def test_quantiles_match_numpy(hot, find):
    df, rows = hot
    probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["feature"]): r for r in find(df, ["x", "y"], probabilities, ["g"]).collect()}
    groups = defaultdict(list)
    for _, g, x, y in rows:
        groups[g, "x"].append(x)
        groups[g, "y"].append(y)
    assert set(got) == set(groups)
    for key, values in groups.items():
        assert got[key]["n"] == len(values)
        assert [got[key][f"q{i}"] for i in range(5)] == pytest.approx(list(np.quantile(values, probabilities)))


def test_quantiles_fall_back_when_a_bracket_misses(hot, monkeypatch):
    df, rows = hot
    monkeypatch.setattr(d, "ACCURACY", 2)
    monkeypatch.setattr(d, "BRACKET", 0.0)
    got = d.quantiles(df, ["y"], [0.3]).first()
    assert got["q0"] == pytest.approx(np.quantile([r[3] for r in rows], 0.3))


def test_quantiles_skip_nulls_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    got = {r["feature"]: r["q0"] for r in d.quantiles(df, ["a", "b"], [0.5]).collect()}
    assert got == {"a": 2.0}


@pytest.mark.parametrize("limit", [0, d.BROADCAST_BYTES])
def test_attach_joins_null_keys_with_and_without_broadcast(hot, limit):
    df, rows = hot
    facts = df.groupBy("g").agg(F.count("*").alias("n"))
    joined = d.attach(df, facts, "g", limit=limit)
    plan = joined._jdf.queryExecution().toString()
    assert ("BroadcastHashJoin" in plan) == (limit > 0)
    assert joined.count() == len(rows)
    assert joined.filter(F.col("g").isNull() & F.col("n").isNull()).count() == 0


def test_hash_cutoffs_find_the_row_at_a_rank(hot):
    df, _ = hot
    cuts = d.hash_cutoffs(df, "id", ["g"], 7, half=F.floor(F.col("n") / 2), none=F.lit(0))
    kept = d.attach(df, cuts, "g").withColumn("in", d.hash_place("id", 7) <= F.col("half"))
    for r in kept.groupBy("g").agg(F.count("*").alias("n"), F.count_if("in").alias("k"), F.count("none").alias("z")).collect():
        assert r["k"] == r["n"] // 2 and r["z"] == 0


def test_cutoffs_refined_level_by_level(spark, monkeypatch):
    """Many digits, one at a time, find the rows that one look at all of them would."""
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 > 0, "a").otherwise(F.when(F.col("id") % 2 > 0, "b")).alias("g"))
    asked = {"first": F.lit(1), "half": F.floor(F.col("n") / 2), "last": F.col("n"), "beyond": F.col("n") + 1}

    def cuts():
        return sorted(map(str, d.hash_cutoffs(df, "id", ["g"], 7, **asked).collect()))
    plain = cuts()
    monkeypatch.setattr(d, "ROWS_PER_SLICE", 1)
    monkeypatch.setattr(d, "DIGITS_AT_ONCE", 1)
    assert cuts() == plain and len(plain) == 3


def test_repeat_rows_cuts_long_runs(spark):
    df = spark.createDataFrame([(1, 0), (2, 3), (3, 25)], "id long, t long")
    got = d.repeat_rows(df, "t", "copy", keys=["id"], run=10).collect()
    assert sorted((r["id"], r["copy"]) for r in got) == [(2, i) for i in range(1, 4)] + [(3, i) for i in range(1, 26)]


def test_checkpoint_folder_comes_from_the_session(spark):
    d.ensure_checkpoint_dir(spark)
    before = spark.sparkContext.getCheckpointDir()
    d.ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir() == before


@pytest.mark.parametrize("block_rows", [7, 2048])
def test_nearest_matches_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    points = [list(map(float, p)) for p in rng.integers(0, 12, size=(60, 2))] + [[5.0, 5.0]] * 40 + [[500.0, 0.0]]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "id long, v array<double>").repartition(5)
    got = defaultdict(list)
    for r in nearest(df, "id", "v", 3, block_rows).orderBy("id", "rank").collect():
        got[r["id"]].append((r["distance"], r["neighbour"]))
    for i, p in enumerate(points):
        every = sorted((round(float(np.hypot(p[0] - q[0], p[1] - q[1])), 6), j) for j, q in enumerate(points) if j != i)
        assert got[i] == every[:3]


def test_nearest_with_fewer_rows_than_neighbours(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, v array<double>")
    assert sorted((r["id"], r["neighbour"]) for r in nearest(df, "id", "v", 5).collect()) == [(1, 2), (2, 1)]


def test_copies_of_a_few_heavy_rows_spread(spark):
    df = spark.range(40).withColumn("t", F.lit(3000).cast("bigint"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = d.repeat_rows(df, "t", "copy", keys=["id"], run=100)
    sizes = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in sizes) == 120_000 and len(sizes) >= 6 and max(r["count"] for r in sizes) < 40_000


def test_neighbours_are_exact_far_from_the_origin(spark):
    rng = np.random.default_rng(11)
    points = 1e6 + rng.normal(size=(200, 3))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>")
    got = {(r["id"], r["rank"]): r["neighbour"] for r in nearest(df, "id", "v", 3).collect()}
    for i, p in enumerate(points):
        distance = np.round(np.sqrt(((points - p) ** 2).sum(1)), 6)
        distance[i] = np.inf
        assert [got[i, r] for r in (1, 2, 3)] == np.lexsort((np.arange(200), distance))[:3].tolist()
