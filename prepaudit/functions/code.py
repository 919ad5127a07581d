"""What a script text says about itself, read with patterns (no parser)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prepaudit.functions import lexical
from prepaudit.functions.text import not_in, rule_tags, strip

# fixed values: preprocessing tags and the substrings that must all occur
PREPROCESSING_RULES = [
    ("text_lowercasing", ["str.lower()"]),
    ("text_stripping", ["str.strip()"]),
    ("text_replacement", ["str.replace"]),
    ("spatial_aggregation", ["apply(lambda", "native-country"]),
    ("standard_scaling", ["StandardScaler"]),
    ("sample_normalization", ["Normalizer"]),
    ("minmax_scaling", ["MinMaxScaler"]),
    ("simple_imputation", ["SimpleImputer"]),
    ("onehot_encoding", ["OneHotEncoder"]),
]

# fixed values: patterns
SKLEARN_IMPORT = r"from\s+sklearn\.(\w+)\s+import\s+([^#\n]+)"
FOREST_CALL = r"RandomForestClassifier\(([^)]*)\)"
SEED = r"random_state=(\d+)"

# fixed values: issue texts
ISSUE_SCALER = ("Generated code uses Normalizer (row-wise normalization) instead of "
                "StandardScaler (column-wise standardization)")
ISSUE_TAGS = [
    ("text_lowercasing", "Generated code lowercases text which may merge distinct categories"),
    ("text_replacement", "Generated code replaces characters in text which may alter meaning"),
    ("spatial_aggregation", "Generated code performs spatial aggregation, losing geographic information"),
]
ISSUE_SEED = "Generated code doesn't set random_state, making results non-reproducible"

IMPORT_LINE = (r"(?m)^[ \t]*(?:from[ \t]+([\w.]+)[ \t]+import[ \t]+(\([^)]*\)|[^#\n;]+)"
               r"|import[ \t]+([^#\n;]+))")


def _listed(names: Column) -> Column:
    """Comma-separated names without brackets and aliases."""
    bare = F.regexp_replace(names, r"[()]", "")
    parts = F.transform(F.split(bare, ","), lambda n: F.regexp_replace(strip(n), r"(?s)\s+as\s.*$", ""))
    return F.filter(parts, lambda n: n != "")


def imports(code: Column) -> Column:
    """``a.b`` for ``import a.b`` and ``m.x`` for ``from m import x``, in text order, repeats kept; none if strings or brackets are left open.

    Only code counts: strings, docstrings and comments are passed over, and several statements may share a line. A null text gives null.
    """
    alone = F.regexp_replace(F.regexp_replace(lexical.code_only(code), ";", "\n"), r":[ \t]+(?=(?:import|from)[ \t])", ":\n")
    alone = F.when(code.isNotNull(), F.coalesce(alone, F.lit("")))
    found = F.arrays_zip(*[F.regexp_extract_all(alone, F.lit(IMPORT_LINE), F.lit(g)).alias(f"g{g}") for g in (1, 2, 3)])

    def of(hit):
        module, names, plain = hit["g1"], hit["g2"], hit["g3"]
        prefixed = F.transform(_listed(names), lambda n: F.concat(module, F.lit("."), n))
        return F.when(module != "", prefixed).otherwise(_listed(plain))
    return F.flatten(F.transform(found, of))


def sklearn_components(code: Column) -> Column:
    """``module.name`` for every name imported from a library submodule."""
    groups = [F.regexp_extract_all(code, F.lit(SKLEARN_IMPORT), F.lit(g)) for g in (1, 2)]
    named = F.zip_with(*groups, lambda module, names: F.transform(
        F.filter(F.transform(F.split(names, ","), lambda n: strip(n)), lambda n: n != ""),
        lambda n: F.concat(module, F.lit("."), n)))
    return F.flatten(named)


def preprocessing_steps(code: Column) -> Column:
    return rule_tags(code, PREPROCESSING_RULES)


def forest_seed(code: Column) -> Column:
    """Seed of the first forest call: its digits, ``True`` when it is no number, null when unset."""
    arguments = F.regexp_extract(code, FOREST_CALL, 1)
    digits = F.nullif(F.regexp_extract(arguments, SEED, 1), F.lit(""))
    return F.when(F.contains(arguments, F.lit("random_state")), F.coalesce(digits, F.lit("True")))


def model_parameters(seed: Column) -> Column:
    return F.when(seed.isNotNull(), F.create_map(F.lit("random_state"), seed)).otherwise(
        F.create_map().cast("map<string,string>"))


def extracted(code: Column, suffix: str) -> dict[str, Column]:
    """All that is read from one script, as columns to compute before they are compared.

    They are separate columns on purpose: used inside a lambda, an expression
    would run again for every item.
    """
    return {f"imports_{suffix}": imports(code), f"sklearn_components_{suffix}": sklearn_components(code),
            f"preprocessing_{suffix}": preprocessing_steps(code), f"seed_{suffix}": forest_seed(code)}


def differences(left: Column, right: Column) -> Column:
    """What the right list lacks and what it adds."""
    return F.struct(not_in(left, right).alias("missing"), not_in(right, left).alias("extra"))


def issues(left: str = "left", right: str = "right") -> Column:
    """Known faults that the right script shows against the left one, from ``extracted`` columns."""
    def has(kind, side, item):
        return F.array_contains(f"{kind}_{side}", item)
    scaler = has("sklearn_components", left, "preprocessing.StandardScaler") & has(
        "sklearn_components", right, "preprocessing.Normalizer")
    found = [F.when(scaler, F.lit(ISSUE_SCALER))]
    for tag, message in ISSUE_TAGS:
        found.append(F.when(has("preprocessing", right, tag) & ~has("preprocessing", left, tag), F.lit(message)))
    lost = F.col(f"seed_{left}").isNotNull() & F.col(f"seed_{right}").isNull()
    found.append(F.when(lost, F.lit(ISSUE_SEED)))
    return F.array_compact(F.array(*found))
