"""Per-function metrics and threshold tags, as expressions over what the parser counted: no shuffle, no Python.

A filter on tags repeats their expressions below it, so they only read columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Thresholds:
    """A metric at or above its threshold raises the tag; none of the defaults rests on research."""

    nesting: int = 4
    sloc: int = 80
    god_sloc: int = 200
    god_branches: int = 15
    params: int = 5


#: Registry order of the detectors; tags of a function come in this order.
DETECTORS = ("deep-nesting", "long-function", "god-function", "too-many-params")


#: What a detail says about where its threshold comes from.
NOTES = {
    "deep-nesting": "a rule of thumb; cognitive-complexity studies weigh nesting but name no absolute limit.",
    "long-function": "no research-backed absolute threshold; style guides differ.",
    "god-function": "counts follow the idea of cyclomatic complexity; the limits are not research-backed.",
    "too-many-params": "linters and books set different limits; none is research-backed.",
}


def n_params() -> Column:
    """Parameters without a leading self or cls, whatever the kind of function."""
    return F.col("n_arguments") - F.when(F.col("first_param").isin("self", "cls"), 1).otherwise(0)


def metrics(functions: DataFrame) -> DataFrame:
    """functions with n_params, max_depth, depth_line, depth_col, sloc and branches in place of the parser's columns for them."""
    counts = ("max_depth", "depth_line", "depth_col", "sloc", "branches")
    left_out = (*counts, "n_arguments", "first_param", "statements", "n_statements", "n_top_statements")
    return functions.select(*(c for c in functions.columns if c not in left_out), n_params().alias("n_params"), *counts)


def with_tags(measured: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """measured with tags: array of (detector_ord, name, detail, line, col) in registry order."""

    def tag(k: int, fires: Column, detail: Column, line: str = "lineno", col: str = "col") -> Column:
        body = F.struct(F.lit(k).alias("detector_ord"), F.lit(DETECTORS[k]).alias("name"), detail.alias("detail"), F.col(line).alias("line"), F.col(col).alias("col"))
        return F.when(fires, body)

    nest = F.format_string("Control flow nested %d levels deep. Default threshold: %d. Source note: %s", "max_depth", F.lit(t.nesting), F.lit(NOTES["deep-nesting"]))
    long = F.format_string("Function body has %d SLOC (excluding docstring and nested-scope bodies). Default threshold: %d. Source note: %s", "sloc", F.lit(t.sloc), F.lit(NOTES["long-function"]))
    god = F.format_string("Function is long AND branchy: %d SLOC, %d branches (if/elif/for/while/except/case). Default thresholds: %d SLOC & %d branches. Source note: %s", "sloc", "branches", F.lit(t.god_sloc), F.lit(t.god_branches), F.lit(NOTES["god-function"]))
    many = F.format_string("Function signature has %d parameters (excluding self/cls; *args and **kwargs count as 1 each). Default threshold: %d. Source note: %s", "n_params", F.lit(t.params), F.lit(NOTES["too-many-params"]))
    tags = F.array(
        tag(0, F.col("max_depth") >= t.nesting, nest, "depth_line", "depth_col"),
        tag(1, F.col("sloc") >= t.sloc, long),
        tag(2, (F.col("sloc") >= t.god_sloc) & (F.col("branches") >= t.god_branches), god),
        tag(3, F.col("n_params") >= t.params, many),
    )
    return measured.withColumn("tags", F.array_compact(tags))


def tags(tagged: DataFrame) -> DataFrame:
    """One row per tag: (path, fn_ord, qualified_name, detector_ord, name, detail, line, col)."""
    return tagged.select("path", "fn_ord", "qualified_name", F.explode("tags").alias("t")).select("path", "fn_ord", "qualified_name", "t.*")


def find(functions: DataFrame, qualified_name: str) -> DataFrame:
    """The first function of that exact name in each file; later redefinitions are not addressed."""
    named = functions.where(F.col("qualified_name") == qualified_name)
    first = named.groupBy("path").agg(F.min("fn_ord").alias("fn_ord"))
    return named.join(first, ["path", "fn_ord"])


def listing(functions: DataFrame) -> DataFrame:
    """One text per file: functions, then methods, then nested functions, each in source order."""
    labels = (("function", "Top-level functions:"), ("method", "Methods:"), ("nested", "Nested functions:"))
    line = F.concat(F.lit("- "), "qualified_name", F.lit(" (line "), F.col("lineno").cast("string"), F.lit(")"))
    items = F.array_sort(F.collect_list(F.struct("fn_ord", "kind", line.alias("line"))))
    grouped = functions.groupBy("path").agg(items.alias("items"))

    def section(kind: str, label: str) -> Column:
        own = F.transform(F.filter("items", lambda i: i["kind"] == kind), lambda i: i["line"])
        return F.when(F.size(own) > 0, F.concat_ws("\n", F.lit(label), F.array_join(own, "\n")))

    return grouped.select("path", F.concat_ws("\n", *(section(*x) for x in labels)).alias("listing"))
