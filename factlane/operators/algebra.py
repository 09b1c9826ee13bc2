"""Evidence algebra: the operators of the engine as functions from DataFrames to DataFrames.

Nothing here knows class files, so each operator can be checked on ordinary tables.  All are declarative: Catalyst
chooses joins and pushes predicates, and no operator collects rows or orders a whole table in one task.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPLETE, PARTIAL, UNKNOWN = "complete", "partial", "unknown"


# -- predicates ---------------------------------------------------------------------------------------------------
def exact(df: DataFrame, keys: dict[str, object]) -> DataFrame:
    """Rows whose key columns all equal the target; a null target matches null."""
    return df.where(reduce(and_, [F.col(c).isNull() if v is None else F.col(c) == F.lit(v) for c, v in keys.items()]))


def literal(df: DataFrame, column: str, value: float) -> DataFrame:
    """Typed literal equality for doubles by bit pattern: NaN is itself, and 0.0 differs from -0.0."""
    target = struct.unpack(">q", struct.pack(">d", value))[0]
    if target in (0, -(1 << 63)):  # the two zeros compare equal; the text of their sign does not
        return df.where((F.col(column) == 0) & (F.col(column).cast("string").startswith("-") == F.lit(target < 0)))
    return df.where(F.isnan(column) if value != value else F.col(column) == F.lit(value))


def of_kinds(df: DataFrame, column: str, kinds: Sequence[str]) -> DataFrame:
    """A versioned, order-insensitive selection of kinds."""
    return df.where(F.col(column).isin(sorted(set(kinds))))


# -- paging and budgets -------------------------------------------------------------------------------------------
def after(order: Sequence[str], cursor: Sequence[object]) -> Column:
    """Rows behind the cursor in lexicographic order of the columns (ascending)."""
    options = []
    for k, (c, v) in enumerate(zip(order, cursor, strict=True)):
        options.append(reduce(and_, [*(F.col(p) == F.lit(w) for p, w in zip(order[:k], cursor[:k], strict=True)), F.col(c) > F.lit(v)]))
    return reduce(or_, options)


def page(df: DataFrame, order: Sequence[str], size: int, cursor: Sequence[object] | None = None) -> DataFrame:
    """At most ``size`` rows behind the cursor, in order, each with has_more; one further row decides that."""
    rows = df.where(after(order, cursor)) if cursor is not None else df
    top = rows.orderBy(*order).limit(size + 1)
    numbered = top.withColumn("page_row", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    more = F.max("page_row").over(Window.partitionBy(F.lit(0))) > size
    return numbered.withColumn("has_more", more).where(F.col("page_row") <= size)


def prefix_sum(df: DataFrame, key: str, cost: str, out: str = "running", ranges: int | None = None) -> DataFrame:
    """The running sum of cost by a numeric unique key, in two steps: sums of key ranges, then within each range."""
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(df.approxQuantile(key, [k / ranges for k in range(1, ranges)], 0.01))) if ranges > 1 else []
    number = reduce(lambda a, b: a + b, [(F.col(key) > F.lit(b)).cast("int") for b in bounds], F.lit(0))
    dealt = df.withColumn("_range", number)
    totals = dealt.groupBy("_range").agg(F.sum(cost).alias("_total"))
    before = totals.select("_range", F.coalesce(F.sum("_total").over(
        Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum(cost).over(Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return (dealt.withColumn("_inside", inside).join(F.broadcast(before), "_range")  # one row a range
            .withColumn(out, F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before"))


def budget_prefix(df: DataFrame, key: str, cost: str, limit: int) -> DataFrame:
    """The longest prefix in key order whose cost stays within the limit."""
    return prefix_sum(df, key, cost).where(F.col("running") <= limit)


# -- completeness -------------------------------------------------------------------------------------------------
def coverage(units: DataFrame, by: Sequence[str], done: Column) -> DataFrame:
    """Three-valued completeness of each group of units: complete only if every unit was read."""
    read = F.count(F.when(done, 1))
    every = F.count(F.lit(1))
    state = F.when(read == every, COMPLETE).when(read > 0, PARTIAL).otherwise(UNKNOWN)
    return units.groupBy(*by).agg(every.alias("units"), read.alias("units_read"), state.alias("state"))


# -- selection ----------------------------------------------------------------------------------------------------
def first_root(candidates: DataFrame, name: Sequence[str], root: str) -> DataFrame:
    """Per name the candidates at its first root; several at one position stay, marked as ambiguous.

    Selection comes before any validation of what was selected: later roots are not consulted.
    """
    w = Window.partitionBy(*name)
    chosen = candidates.withColumn("_first", F.min(root).over(w)).where(F.col(root) == F.col("_first")).drop("_first")
    return chosen.withColumn("n_candidates", F.count(F.lit(1)).over(w)).withColumn(
        "state", F.when(F.col("n_candidates") > 1, "ambiguous").otherwise("resolved"))


def level_at_most(df: DataFrame, by: Sequence[str], level: str, bound: Column, tie: str) -> DataFrame:
    """The row with the greatest level that is at most the bound, per group: an as-of choice without a sort."""
    return (df.where(F.col(level) <= bound).groupBy(*by)
            .agg(F.max(F.struct(F.col(level), F.col(tie))).alias("_best")).select(*by, f"_best.{level}", f"_best.{tie}"))


def resolved(left: DataFrame, right: DataFrame, on: Sequence[str], mark: str, missing: str = "missing") -> DataFrame:
    """Left outer resolution: what has no definition is kept, with a status instead of a null."""
    return left.join(right.withColumn("_there", F.lit(True)), list(on), "left").withColumn(
        mark, F.when(F.col("_there"), "resolved").otherwise(missing)).drop("_there")


# -- closures -----------------------------------------------------------------------------------------------------
def _composed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Steps of a, then steps of b: (root, node, depth), each pair at its least depth."""
    on = b.select(F.col("root").alias("node"), F.col("node").alias("over"), F.col("depth").alias("more"))
    return a.join(on, "node").groupBy("root", F.col("over").alias("node")).agg(F.min(F.col("depth") + F.col("more")).alias("depth"))


def closure(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth) reached over edges (child, parent) within ``depth`` steps, each node at its least depth.

    Steps are doubled, so a depth of eight is three joins; what a pair needs is kept once, at its least depth.
    """
    step = edges.select(F.col("child").alias("root"), F.col("parent").alias("node")).where("root <> node").distinct().withColumn("depth", F.lit(1))
    start = roots.select("root").distinct()
    nodes = step.select("root").union(step.select("node")).union(start).distinct()
    power = nodes.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).unionByName(step)
    found = None
    while depth:
        if depth & 1:
            found = power if found is None else _composed(found, power)
        depth >>= 1
        if depth:
            power = _composed(power, power)
    if found is None:
        return start.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    return found.join(start, "root", "left_semi")


# -- presentation -------------------------------------------------------------------------------------------------
def grouped(df: DataFrame, owner: Sequence[str], item: str, out: str = "items") -> DataFrame:
    """Items of each owner as one ordered text."""
    return df.groupBy(*owner).agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col(item).cast("string"))), ",").alias(out))


def finding(resolved_: Column, structural: Column) -> Column:
    """The three classes of findings, which never merge."""
    return F.when(resolved_, "resolved_declaration").when(structural, "structural_reference").otherwise("constant_pool_candidate")


def outcome(n: Column, complete: Column) -> Column:
    """What a name is bound to: one, many, or not known because the search is unfinished."""
    return F.when(~complete, "incomplete").when(n == 1, "performed").when(n > 1, "ambiguous").otherwise("missing")
