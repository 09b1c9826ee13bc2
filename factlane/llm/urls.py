"""URL filters: rules first, then a path-template tree of each host, with DataFrame operations alone.

The distinct (host, path) pairs with their page counts and labels are grown into templates, one path segment a
level.  Labels are the verdicts of the rules.  At a level, the children of one template that have the same
shape (digits, letters and signs in order, runs as one) are generalised together:
- variable segments become the wildcard of their shape: where digits occur in at least MANY different ones, or
  where there are MANY different ones and more than VARIED of the pages show a new one;
- branches with at least LABELS labels each that are statistically similar (a two-proportion test of their
  share of blocked pages against their shape's at |z| < Z) are merged; others stay as they are.
A template is rejected if its smoothed purity, (blocked + PRIOR) / (labelled + 2 PRIOR), is at least PURE.
A page that no rule fits gets its template's verdict.  Levels go on as deep as paths do: where a template has one path
alone, what is left of that path is its template, and it is done.

A null url, or one without ``://``, has an empty host and path and is allowed.  Repeated rows get equal rows; of two
rules of one length that fit, the first wins.  Urls of any length are judged whole.  Other columns are ignored.
Pages are only aggregated by (host, path), so hot hosts and hot pages are summed before they are dealt; sums go back
to their rows by joins that broadcast what hot keys need (see ``storage.hot_join``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import hot_join, stored

#: (verdict, host, path)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
MANY, VARIED, LABELS, Z, PRIOR, PURE = 3, 0.5, 5, 1.96, 2.0, 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule(rules: list[tuple[str, str, str]], what: str) -> Column:
    """The longest fitting rule (of equal ones the first): its text or its verdict; null where none fits."""
    out = F.lit(None).cast("string")
    for verdict, name, prefix in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(prefix)
        out = F.when(fits, F.lit(name + prefix if what == "rule" else verdict)).otherwise(out)
    return out


def shape(segment: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(segment, "[0-9]+", "9"), r"[\p{L}]+", "a")


def _level(tree: DataFrame, depth: int) -> DataFrame:
    """The templates one segment longer; every path of tree has so many."""
    here = tree.withColumn("segment", F.col("segments")[depth])
    key = ["host", "template", "segment"]
    children = stored(here.groupBy(*key).agg(F.count(F.lit(1)).alias("paths"), *[F.sum(c).alias(c) for c in ("n", "blocked", "labelled")])
                      .withColumn("shape", shape(F.col("segment"))), f"urls-children{depth}")
    kinds = stored(children.groupBy("host", "template", "shape")
                   .agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("pages"),
                        F.sum(F.when(F.col("labelled") >= LABELS, F.col("blocked"))).alias("all_blocked"),
                        F.sum(F.when(F.col("labelled") >= LABELS, F.col("labelled"))).alias("all_labelled")), f"urls-kinds{depth}")
    told = hot_join(children, kinds, ["host", "template", "shape"])
    variable = (F.col("kinds") >= MANY) & (F.col("shape").contains("9") | (F.col("kinds") > VARIED * F.col("pages")))
    others = F.col("all_labelled") - F.col("labelled")
    p = F.col("all_blocked") / F.col("all_labelled")
    difference = F.col("blocked") / F.col("labelled") - (F.col("all_blocked") - F.col("blocked")) / others
    error = F.sqrt(p * (1 - p) * (1 / F.col("labelled") + 1 / others))
    similar = (F.col("labelled") >= LABELS) & (others > 0) & (F.abs(difference) <= Z * error)
    step = F.when(variable, F.concat(F.lit("<"), "shape", F.lit(">"))).when(similar, F.concat(F.lit("{"), "shape", F.lit("}"))).otherwise(F.col("segment"))
    steps = stored(told.select(*key, step.alias("step")), f"urls-steps{depth}")
    return hot_join(here, steps, key).withColumn("template", F.concat("template", F.lit("/"), "step")).drop("segment", "step")


def templates(pages: DataFrame) -> DataFrame:
    """(host, path, template, blocked, labelled, purity) of the distinct (host, path) of pages with a verdict column."""
    paths = (pages.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("verdict") == "block", 1)).alias("blocked"),
                                               F.count("verdict").alias("labelled"))
             .withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn("template", F.lit("")))
    tree, done, depth = stored(paths, "urls-paths"), [], 0
    while True:
        alone = stored(tree.groupBy("host", "template").agg(F.count(F.lit(1)).alias("paths")), f"urls-nodes{depth}")
        told = stored(hot_join(tree, alone, ["host", "template"]), f"urls-open{depth}")
        rest = F.slice("segments", F.lit(depth + 1), F.greatest(F.size("segments") - depth, F.lit(0)))
        over = (F.size("segments") <= depth) | (F.col("paths") == 1)
        done.append(told.where(over).withColumn("template", F.concat_ws("/", "template", rest)).drop("paths"))
        tree = told.where(~over).drop("paths")
        if tree.isEmpty():
            break
        tree = stored(_level(tree, depth), f"urls-level{depth}")
        depth += 1
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    sums = stored(whole.groupBy("host", "template").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled")), "urls-templates")
    sums = sums.withColumn("purity", (F.col("blocked") + PRIOR) / (F.col("labelled") + 2 * PRIOR))
    return hot_join(whole.select("host", "path", "template"), sums, ["host", "template"])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per page of (page_id, url): page_id, host, path, rule, verdict, template, purity."""
    url = F.col("url").cast("string")
    parsed = pages.select("page_id", host(url).alias("host"), path(url).alias("path"))
    parsed = parsed.withColumns({"rule": rule(rules, "rule"), "verdict": rule(rules, "verdict")})
    tree = stored(templates(parsed), "urls-judged")
    method = F.when(F.col("purity") >= PURE, "block").otherwise("allow")
    return (hot_join(parsed, tree, ["host", "path"], "left")
            .select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "template", "purity"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
