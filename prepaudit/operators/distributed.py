"""Building blocks that keep the other operators free of hot tasks.

* ``attach`` joins a fitted table to the rows it was fitted for. It measures the
  table first and broadcasts it only below a byte limit; above it the join is an
  ordinary shuffle join, which adaptive execution may split where a key is hot.
* ``running_total`` and ``quantiles`` cumulate over a whole group without
  collecting the group in one task.
* ``hash_cutoffs`` finds the row at a given rank of a group's hash order, so that
  "the first n rows of each class" becomes a comparison and no row is shuffled.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prepaudit.functions.hashing import digest
from prepaudit.functions.rows import stacked

BROADCAST_BYTES = 32 * 1024 * 1024
ROWS_PER_SLICE = 65_536
ACCURACY = 10_000
BRACKET = 3 / ACCURACY
DIGITS_AT_ONCE = 3
#: While this holds, Spark removes a query's shuffle files when the query ends, not when the driver collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; only a session in one process may do without."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local") and "cluster" not in context.master:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="prepaudit-checkpoint-"))  # one process, one machine
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def settle(df: DataFrame) -> DataFrame:
    """Compute once and keep in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Write once as Parquet below the shared checkpoint folder and read it back.

    Lineage ends there, so a lost executor costs no more than the task it ran.
    The folder is the cluster's to clean, like every checkpoint. Shuffles behind the table go as soon as it is written.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def names(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def one_row(df: DataFrame, **values: Column) -> DataFrame:
    """A single row made of scalar subqueries."""
    return df.sparkSession.range(1).select(*[v.alias(k) for k, v in values.items()])


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast after measuring the settled table, else leave it alone."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def attach(df: DataFrame, facts: DataFrame, on: str | Sequence[str], how: str = "inner",
           limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join ``facts`` (one row per key) to ``df``; a null key matches a null key."""
    keys = names(on)
    rest = [F.col(c) for c in facts.columns if c not in keys]
    right = settle(facts.select(*[F.col(k).alias(f"__{k}") for k in keys], *rest))
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(right[f"__{k}"]) for k in keys])
    joined = df.join(broadcast_if_small(right, limit), same, how)
    return joined.drop(*[f"__{k}" for k in keys])


def running_total(df: DataFrame, by: str | Sequence[str], order: Sequence[str],
                  **totals: str | Column) -> DataFrame:
    """Add inclusive running sums per ``by`` group in ``order`` (which must be unique there).

    The rows are cut into sorted slices that ignore group borders, so a hot group
    spreads over many tasks. Sums run inside each slice and are then raised by what
    earlier slices hold of the same group. Only the first group of a slice can
    have begun earlier, so that correction has at most one row per slice.
    """
    by = names(by)
    columns = df.columns
    inputs = {f"__{out}": (F.col(v) if isinstance(v, str) else v) for out, v in totals.items()}
    sliced = settle(
        df.withColumns(inputs)
        .repartitionByRange(*[F.col(c) for c in [*by, *order]])
        .withColumn("__slice", F.spark_partition_id())
    )
    per_slice = sliced.groupBy(*by, "__slice").agg(*[F.sum(c).alias(c) for c in inputs])
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        per_slice.withColumns({f"{c}_before": F.sum(c).over(before) for c in inputs})
        .filter(F.col(f"{next(iter(inputs))}_before").isNotNull())
        .select("__slice", F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(by)]).alias("__group"),
                *[f"{c}_before" for c in inputs])
        .withColumnRenamed("__slice", "__slice_of")
    )
    inside = Window.partitionBy("__slice", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumns({c: F.sum(c).over(inside) for c in inputs})
    group = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(by)]) if by else F.struct(F.lit(0))
    if not by:
        carried = carried.withColumn("__group", F.struct(F.lit(0)))
    same = (local["__slice"] == carried["__slice_of"]) & group.eqNullSafe(carried["__group"])
    joined = local.join(F.broadcast(carried), same, "left")
    return joined.select(
        *columns,
        *[(F.col(f"__{o}") + F.coalesce(F.col(f"__{o}_before"), F.lit(0))).alias(o) for o in totals],
    )


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), kind: str = "double") -> DataFrame:
    """Long counts ``(by..., feature, value, n)`` of the non-null values of some columns."""
    cells = stacked(*[{"feature": c, "value": F.col(c).cast(kind)} for c in columns])
    return (
        df.select(*by, F.inline(cells))
        .filter(F.col("value").isNotNull())
        .groupBy(*by, "feature", "value")
        .agg(F.count("*").alias("n"))
    )


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
              by: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantiles ``(by..., feature, n, q0, q1, ...)``.

    The ``percentile`` aggregate keeps every distinct value of a group in one
    task's memory. Here a sketch of bounded size first brackets each quantile. Only values inside
    a bracket, a fraction of a percent, are then counted one by one and ranked;
    what lies outside is only counted. A bracket that missed its rank would show as a
    null, and then all distinct values are counted instead.
    """
    by = list(by)
    group = [*by, "feature"]
    edges = [min(1.0, max(0.0, p + side * BRACKET)) for p in probabilities for side in (-1, 1)]
    wide = df.select(*by, *[F.col(c).cast("double").alias(f"__v{j}") for j, c in enumerate(columns)])
    sketched = settle(wide.groupBy(*by).agg(*[x for j in range(len(columns)) for x in (
        F.percentile_approx(f"__v{j}", F.array(*[F.lit(e) for e in edges]), F.lit(ACCURACY)).alias(f"__e{j}"),
        F.count(f"__v{j}").alias(f"__n{j}"))]))
    cells = _cells(wide, sketched, list(columns), len(probabilities)) if not by else _cells_by(wide, sketched, columns, probabilities, by)
    ranked = running_total(cells, [*group, "__i"], ["__side", "__value"], __upto="__n")
    picked = settle(_pick_quantiles(ranked, group, probabilities))
    if picked.filter(reduce(lambda a, b: a | b, [F.col(f"q{i}").isNull() for i in range(len(probabilities))])).limit(1).count():
        return quantiles_by_counting(df, columns, probabilities, by)
    return picked


def _cells(wide: DataFrame, sketched: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """For whole columns: each task counts below, above and (by value) inside every bracket, and sends no other rows."""
    told = sketched.first()
    names = ["feature", "__i", "__side", "__value", "__n", "__least", "__most", "__total"]
    brackets = [(told[f"__e{j}"] or [], int(told[f"__n{j}"])) for j in range(len(columns))]

    def run(batches):
        outside, inside = {}, {}
        for batch in batches:
            for j, (edges, _) in enumerate(brackets):
                v = batch.column(f"__v{j}").drop_null().to_numpy(zero_copy_only=False)
                for i in range(n) if len(v) and edges else ():
                    below, within = v < edges[2 * i], (v >= edges[2 * i]) & (v <= edges[2 * i + 1])
                    for side, some in ((-1, below), (1, ~(below | within))):  # NaN is above all, as in every order of Spark's
                        if some.any():
                            known = outside.setdefault((j, i, side), [0, np.inf, -np.inf])
                            known[0] += int(some.sum())
                            known[1], known[2] = min(known[1], float(np.sort(v[some])[0])), max(known[2], float(v[some].max()))
                    held = inside.setdefault((j, i), [])
                    held.append(np.unique(v[within] + 0.0, return_counts=True))
                    if len(held) > 64:
                        inside[j, i] = [_united(held)]
        rows = [(columns[j], i, side, None, k, least if side > 0 else None, most if side < 0 else None, brackets[j][1])
                for (j, i, side), (k, least, most) in outside.items()]
        for (j, i), held in inside.items():
            rows += [(columns[j], i, 0, v, k, v, v, brackets[j][1]) for v, k in zip(*(x.tolist() for x in _united(held)))]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        for k in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k:k + 10_000]), kinds)], names)
    found = wide.mapInArrow(run, "feature string, __i int, __side int, __value double, __n bigint, __least double, __most double, __total bigint")
    return found.groupBy("feature", "__i", "__side", "__value").agg(
        F.sum("__n").alias("__n"), F.min("__least").alias("__least"), F.max("__most").alias("__most"), F.max("__total").alias("__total"))


def _united(parts: list) -> tuple:
    values, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    return values, np.bincount(at, np.concatenate([k for _, k in parts]), len(values)).astype(np.int64)


def _cells_by(wide: DataFrame, sketched: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str]) -> DataFrame:
    """The same within groups, whose brackets are joined to the rows."""
    group, tagged = [*by, "feature"], attach(wide, sketched, by)
    places = [(j, c, i) for j, c in enumerate(columns) for i in range(len(probabilities))]

    def low(j, i):
        return F.get(f"__e{j}", F.lit(2 * i))

    def high(j, i):
        return F.get(f"__e{j}", F.lit(2 * i + 1))
    # What lies outside a bracket is counted on the wide row, in one aggregation; only values inside become rows.
    counted = tagged.groupBy(*by).agg(*[x for j, _, i in places for x in (
        F.count_if(F.col(f"__v{j}") < low(j, i)).alias(f"__b{j}_{i}"), F.max(F.when(F.col(f"__v{j}") < low(j, i), F.col(f"__v{j}"))).alias(f"__m{j}_{i}"),
        F.count_if(F.col(f"__v{j}") > high(j, i)).alias(f"__a{j}_{i}"), F.min(F.when(F.col(f"__v{j}") > high(j, i), F.col(f"__v{j}"))).alias(f"__l{j}_{i}"))],
        *[F.max(f"__n{j}").alias(f"__n{j}") for j in range(len(columns))])
    none = F.lit(None).cast("double")
    outside = counted.select(*by, F.inline(stacked(*[{
        "feature": c, "__i": i, "__side": side, "__value": none, "__n": F.col(f"__{n}{j}_{i}"),
        "__least": F.col(f"__l{j}_{i}") if side > 0 else none, "__most": F.col(f"__m{j}_{i}") if side < 0 else none, "__total": F.col(f"__n{j}")}
        for j, c, i in places for side, n in ((-1, "b"), (1, "a"))]))).filter(F.col("__n") > 0)
    near = F.inline(stacked(*[{"feature": c, "__i": i, "__value": F.when(F.col(f"__v{j}").between(low(j, i), high(j, i)), F.col(f"__v{j}")),
                      "__total": F.col(f"__n{j}")} for j, c, i in places]))
    inside = tagged.select(*by, near).filter(F.col("__value").isNotNull()).groupBy(*group, "__i", "__value").agg(
        F.count("*").alias("__n"), F.max("__total").alias("__total"))
    return outside.unionByName(inside.withColumns({"__side": F.lit(0), "__least": F.col("__value"), "__most": F.col("__value")}))


def quantiles_by_counting(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
                          by: Sequence[str] = ()) -> DataFrame:
    """The same from the running count of all distinct values."""
    group = [*by, "feature"]
    counted = value_counts(df, columns, by).withColumnsRenamed({"n": "__n", "value": "__value"})
    totals = df.groupBy(*by).agg(*[F.count(c).alias(f"n_{c}") for c in columns])
    totals = totals.select(*by, F.inline(stacked(*[{"feature": c, "__total": F.col(f"n_{c}")} for c in columns])))
    every = attach(running_total(counted, group, ["__value"], __upto="__n"), totals, group).withColumns(
        {"__side": F.lit(0), "__least": F.col("__value"), "__most": F.col("__value")})
    wanted = F.explode(F.array(*[F.lit(i) for i in range(len(probabilities))]))
    return _pick_quantiles(every.withColumn("__i", wanted), group, probabilities)


def _pick_quantiles(ranked: DataFrame, group: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Interpolate between the values at the two ranks around each quantile.

    A row holds the ranks from ``__upto - __n`` to below ``__upto``. Of a row that stands for all values
    below (above) a bracket only the last (first) is known.
    """
    first, end = F.col("__upto") - F.col("__n"), F.col("__upto")
    picks, results = [], []
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("__total") - 1)
        for name, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            known = F.when(F.col("__side") == 0, F.col("__value")).when(
                (F.col("__side") < 0) & (rank == end - 1), F.col("__most")).when(
                (F.col("__side") > 0) & (rank == first), F.col("__least"))
            here = (F.col("__i") == i) & (first <= rank) & (rank < end)
            picks.append(F.max(F.when(here, known)).alias(f"__{name}{i}"))
        share = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        results.append((low + (high - low) * (share - F.floor(share))).alias(f"q{i}"))
    return ranked.groupBy(*group).agg(F.max("__total").alias("n"), *picks).select(*group, "n", *results)


def repeat_rows(df: DataFrame, times: str, output: str, keys: Sequence[str], run: int = 100_000) -> DataFrame:
    """Each row ``times`` times, numbered from 1; ``keys`` tell rows apart.

    A row that repeats very often is cut into runs that are dealt out to tasks
    before they are written out. Pass a settled frame: it is read twice.
    """
    one = F.lit(1).cast("bigint")
    few = df.filter(F.col(times).between(1, run)).withColumn(output, F.explode(F.sequence(one, F.col(times))))
    starts = F.explode(F.sequence(one, F.col(times), F.lit(run).cast("bigint")))
    many = df.filter(F.col(times) > run).withColumn("__start", starts).repartition(*keys, "__start")
    last = F.least(F.col("__start") + F.lit(run - 1), F.col(times))
    many = many.withColumn(output, F.explode(F.sequence(F.col("__start"), last))).drop("__start")
    return few.unionByName(many)


def hash_cutoffs(df: DataFrame, key: str, by: Sequence[str], seed, **ranks: Column) -> DataFrame:
    """Per group, the hash-order position of given 1-based ranks: one struct column per rank.

    ``ranks`` are expressions over ``n``, the group size; a rank below 1 gives
    null. Rows are first counted per group and hash prefix. Only the rows that
    share a prefix with a wanted rank are ranked, so nothing else moves.
    """
    by = list(by)
    keyed = df.select(*by, F.col(key).alias("__key"), digest(seed, key).alias("__hash"))
    largest = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    digits = 1
    while largest > ROWS_PER_SLICE * 16 ** digits / 16:  # more digits for larger groups: a slice stays small
        digits += 1
    wanted = F.inline(stacked(*[{"__name": name, "__rank": r.cast("bigint")} for name, r in ranks.items()]))
    # A few digits at a time: cells are cumulated only where a wanted rank lies, at most 16 ** DIGITS_AT_ONCE of one group or cell in a task.
    held, known = None, 0
    while known < digits:
        width = min(digits, known + DIGITS_AT_ONCE)
        rows = keyed.withColumn("__parent", F.substring("__hash", 1, known) if known else F.lit(""))
        if held is not None:
            rows = attach(rows, held.select(*by, "__parent").distinct(), [*by, "__parent"])
        sizes = rows.groupBy(*by, "__parent", F.substring("__hash", 1, width).alias("__prefix")).agg(F.count("*").alias("__size"))
        whole = Window.partitionBy(*by, "__parent")
        upto = whole.orderBy("__prefix").rowsBetween(Window.unboundedPreceding, 0)
        cells = sizes.withColumns({"n": F.sum("__size").over(whole), "__upto": F.sum("__size").over(upto)})
        if held is None:
            asked = cells.select(*by, "__prefix", "__size", "__upto", wanted)
        else:
            asked = attach(cells, held.groupBy(*by, "__parent").agg(F.collect_list(F.struct("__name", "__rank")).alias("__asked")), [*by, "__parent"]).select(
                *by, "__prefix", "__size", "__upto", F.inline("__asked"))
        local = F.col("__rank") - (F.col("__upto") - F.col("__size"))
        held = settle(asked.withColumn("__local", local).filter(F.col("__local").between(1, F.col("__size"))).select(
            *by, F.col("__prefix").alias("__parent"), F.col("__local").alias("__rank"), "__name"))
        known = width
    targets = held.groupBy(*by, F.col("__parent").alias("__prefix")).agg(
        F.collect_list(F.struct(F.col("__rank").alias("__local"), "__name")).alias("__wanted"))
    keyed = keyed.withColumn("__prefix", F.substring("__hash", 1, digits))
    near = attach(keyed, targets, [*by, "__prefix"])
    rank = F.row_number().over(Window.partitionBy(*by, "__prefix").orderBy("__hash", "__key"))
    hits = near.withColumn("__at", rank).select(*by, "__hash", "__key", "__at", F.inline("__wanted"))
    hits = hits.filter(F.col("__at") == F.col("__local"))
    place = F.struct("__hash", "__key")
    return hits.groupBy(*by).agg(
        *[F.max(F.when(F.col("__name") == name, place)).alias(name) for name in ranks])


def hash_place(key: str, seed) -> Column:
    """The position that ``hash_cutoffs`` compares with."""
    return F.struct(digest(seed, key).alias("__hash"), F.col(key).alias("__key"))


def scalars(row: DataFrame, columns: Mapping[str, str] | Sequence[str] | None = None) -> dict[str, Column]:
    """Each column of a one-row table as a scalar subquery: no join, and one row is enforced."""
    return {c: row.select(c).scalar() for c in (columns or row.columns)}
