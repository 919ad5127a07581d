"""Secrets in texts: fixed patterns, and strings that a randomness test battery cannot tell from noise.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prepaudit.llm.shared import read, register, store, text_of

#: kind -> (pattern, group whose length counts, least length)
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}+", 0, 16),
}
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: encoding -> (alphabet, pattern of the whole string without padding), the first that fits is inferred
ENCODINGS = {
    "hex": (DIGITS + "abcdef", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$"),
    "HEX": (DIGITS + "ABCDEF", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$"),
    "base32": (UPPER + "234567", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$"),
    "lower36": (LOWER + DIGITS, r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$"),
    "upper36": (UPPER + DIGITS, r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$"),
    "base62": (UPPER + LOWER + DIGITS, r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z]+$"),
    "base64": (UPPER + LOWER + DIGITS + "+/", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/]+$"),
    "base64url": (UPPER + LOWER + DIGITS + "-_", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z_-]+$"),
}
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}+={0,2}"
LEAST_BITS = 80.0
FALSE_DISCOVERY = 0.05
BINS_PER_DECADE = 50


def spans(text: Column, pattern: str, *groups: int) -> Column:
    """``array<struct<start, end, g...>>`` of all matches, in code points, end exclusive.

    The text between matches and the matches alternate, so their lengths add up to the positions.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    wanted = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups]
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.arrays_zip(whole.alias("m"), gaps.alias("gap"), *[w.alias(f"g{i}") for i, w in enumerate(wanted)])
    names = ["m", "gap", *[f"g{i}" for i in range(len(groups))]]
    kind = "struct<at:int,out:array<struct<start:int,end:int" + "".join(f",g{i}:string" for i in range(len(groups))) + ">>>"

    def step(so_far: Column, row: Column) -> Column:
        begin = so_far["at"] + row[names[1]]
        end = begin + F.length(row[names[0]])
        found = F.struct(begin.alias("start"), end.alias("end"), *[row[n].alias(n) for n in names[2:]])
        return F.struct(end.alias("at"), F.concat(so_far["out"], F.array(found)).alias("out")).cast(kind)
    rows = F.slice(rows, 1, F.greatest(F.size(whole), F.lit(1)))
    empty = F.from_json(F.lit('{"at":0,"out":[]}'), kind)
    found = F.aggregate(rows, empty, step)["out"]
    return F.when(text.rlike(pattern), found).otherwise(empty["out"])


def _base(text: Column) -> Column:
    def of_kind(number: int, kind: str) -> Column:
        pattern, group, least = PATTERNS[kind]
        long_enough = F.filter(spans(text, pattern, group), lambda s: F.length(s["g0"]) >= least)
        return F.transform(long_enough, lambda s: F.struct(
            s["start"].alias("start"), F.lit(number).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    return F.array_sort(F.concat(*[of_kind(i, kind) for i, kind in enumerate(PATTERNS)]))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by the classic five-term polynomial (error below 1e-7)."""
    t = 1.0 / (1.0 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(candidates: DataFrame, token: str = "token") -> DataFrame:
    """Add ``encoding``, ``n``, ``bits`` and ``p``, the combined p-value of the hypothesis "uniformly random".

    * chi-squared: symbol counts against equal shares of the encoding's alphabet (upper tail, with the exact
      mean and variance of the statistic, as texts are short);
    * runs: changes between the lower and the upper half of the alphabet (two-sided);
    * serial correlation of neighbouring symbol values (two-sided).

    The three combine by three times the least p-value. A token that fits no encoding has a null encoding and p.
    Each test is linear in the token's length.
    """
    body = F.rtrim(F.col(token), F.lit("="))
    guess = F.lit(None).cast("string")
    for name, (_, pattern) in reversed(ENCODINGS.items()):
        guess = F.when(body.rlike(pattern), F.lit(name)).otherwise(guess)
    alphabet, half = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (letters, _) in ENCODINGS.items():
        alphabet = F.when(F.col("encoding") == name, F.lit(letters)).otherwise(alphabet)
        middle = len(letters) // 2
        half = F.when(F.col("encoding") == name,
                      F.translate(F.col("__body"), letters, "0" * middle + "1" * (len(letters) - middle))).otherwise(half)
    df = candidates.withColumn("__body", body).withColumn("encoding", guess)
    df = df.withColumns({"__alphabet": alphabet, "__half": half, "n": F.length("__body").cast("double")})
    df = df.withColumn("__k", F.length("__alphabet").cast("double"))
    n, k = F.col("n"), F.col("__k")
    counts = F.transform(F.split("__alphabet", ""), lambda c: n - F.length(F.replace(F.col("__body"), c, F.lit(""))))
    squares = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c)
    values = F.transform(F.split("__body", ""), lambda c: F.instr(F.col("__alphabet"), c).cast("double"))
    df = df.withColumns({"__squares": squares, "__values": values})
    ones = F.length(F.replace("__half", F.lit("0"), F.lit(""))).cast("double")
    changes = sum((F.length("__half") - F.length(F.replace("__half", F.lit(x), F.lit("")))) / 2 for x in ("01", "10"))
    mean = F.aggregate("__values", F.lit(0.0), lambda s, v: s + v) / n
    df = df.withColumns({"__ones": ones, "__runs": changes + 1, "__mean": mean})
    off = F.transform("__values", lambda v: v - F.col("__mean"))
    df = df.withColumn("__off", off)
    neighbours = F.zip_with(F.slice("__off", F.lit(1), F.size("__off") - 1), F.slice("__off", F.lit(2), F.size("__off") - 1),
                            lambda a, b: a * b)
    add = lambda s, v: s + v
    spread = F.aggregate(F.transform("__off", lambda v: v * v), F.lit(0.0), add)
    serial = F.when(spread > 0, F.aggregate(neighbours, F.lit(0.0), add) / spread).otherwise(1.0)
    both = 2 * F.col("__ones") * (n - F.col("__ones"))
    run_mean, run_var = both / n + 1, both * (both - n) / (n * n * (n - 1))
    z_chi = (F.col("__squares") * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
    z_runs = F.when(run_var > 0, (F.col("__runs") - run_mean) / F.sqrt(run_var)).otherwise(8.0)
    p_values = [_upper_tail(z_chi), 2 * _upper_tail(F.abs(z_runs)), 2 * _upper_tail(F.abs(serial + 1 / n) * F.sqrt(n))]
    df = df.withColumns({"p": F.least(F.lit(1.0), 3 * F.least(*p_values)), "bits": n * F.log2(k)})
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def keep_random(tested: DataFrame, q: float = FALSE_DISCOVERY) -> DataFrame:
    """Drop what the battery proves to be ordinary, by Benjamini-Hochberg within each length class and encoding.

    At most a share ``q`` of what is dropped is expected to be truly random. p-values are
    binned upwards, which keeps that bound, so the cut-off comes from a table of counts and no class is ever sorted
    in one task. Strings with fewer than ``LEAST_BITS`` bits are never called random: the tests have no power there.
    """
    classed = tested.filter(F.col("encoding").isNotNull() & (F.col("bits") >= LEAST_BITS)).withColumns({
        "__class": F.floor(F.log2("n")).cast("int"),
        "__bin": F.floor(F.log10(F.greatest("p", F.lit(1e-300))) * BINS_PER_DECADE).cast("int")})
    group = ["encoding", "__class"]
    bins = classed.groupBy(*group, "__bin").agg(F.count("*").alias("n_bin"))
    ranked = bins.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("__bin", "n_bin"))).alias("bins"), F.sum("n_bin").alias("m"))
    none = F.struct(F.lit(0).cast("bigint").alias("rank"), F.lit(None).cast("int").alias("cut"))

    def step(state: Column, row: Column) -> Column:
        rank = state["rank"] + row["n_bin"]
        top = F.pow(F.lit(10.0), (row["__bin"] + 1) / BINS_PER_DECADE)
        return F.struct(rank.alias("rank"), F.when(top <= q * rank / F.col("m"), row["__bin"])
                        .otherwise(state["cut"]).alias("cut"))
    cuts = ranked.select(*group, F.aggregate("bins", none, step)["cut"].alias("__cut"))
    return (classed.join(F.broadcast(cuts), group)  # at most one row per encoding and binary order of length
            .filter(F.col("__cut").isNull() | (F.col("__bin") > F.col("__cut"))).drop("__class", "__bin", "__cut"))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(<key>, base, added)``: arrays of ``struct<start, order, kind, end>``, one row per input row.

    ``base`` holds the matches of the fixed patterns, ``added`` the further strings (kind ``random``) that the battery
    does not reject and that lie in no base span. Positions are code points, ends exclusive. A null text counts as empty
    and has no spans; rows are never merged, also when ids repeat or are null; an empty table gives an empty table; other
    columns are ignored, whatever their names.
    """
    body = docs.select(F.col(key).alias("id"), text_of(text).alias("body"))
    scanned = body.select("id", _base(F.col("body")).alias("base"), spans(F.col("body"), CANDIDATE, 0).alias("loose"))
    loose = F.filter("loose", lambda c: c["g0"].rlike("[0-9]") & c["g0"].rlike("[A-Za-z]") & ~F.exists(
        F.col("base"), lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"])))
    rows = store(scanned.select(F.monotonically_increasing_id().alias("row"), "id", "base", loose.alias("loose")))
    candidates = rows.select("row", F.explode("loose").alias("c")).select(
        "row", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.g0").alias("token"))
    random = keep_random(battery(candidates)).groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
        "start", F.lit(len(PATTERNS)).alias("order"), F.lit("random").alias("kind"), "end"))).alias("added"))
    empty = F.filter("base", lambda _: F.lit(False))
    return rows.drop("loose").join(random, "row", "left").select(
        F.col("id").alias(key), "base", F.coalesce("added", empty).alias("added"))


def written(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@register("op5_secret_scans")
def op5_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(read(spark, folder, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(kind) for kind in PATTERNS], F.sha2(written(F.col("base")), 256).alias("base_sha256"),
                        written(F.array_sort(F.concat("base", "added"))).alias("spans"))
