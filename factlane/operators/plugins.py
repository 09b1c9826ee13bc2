"""Semantic rules over authorised resources and references: registered, versioned, isolated.

A rule is a function from the units to findings (subject, detail).  It gets no session, network or launcher of its own
beyond these tables, its findings stand apart from structural results, and a rule that fails is reported as stopped
without failing the others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import artifact as S
from ..sources.store import settled


@dataclass(frozen=True)
class Rule:
    id: str
    version: int
    input: str  # resources, xrefs or classes
    budget: str  # the dimension that it charges
    trust: str  # always builtin: there is no loading of foreign rules
    find: Callable[[DataFrame], DataFrame]


def _providers(u: DataFrame) -> DataFrame:
    return S.resource_rows(u).where("rule = 'service'").select("path", F.concat(F.lit("service:"), "key").alias("subject"), F.col("value").alias("detail"))


def _entry_points(u: DataFrame) -> DataFrame:
    return S.resource_rows(u).where("rule = 'manifest' and key in ('Main-Class', 'Premain-Class', 'Agent-Class', 'Launcher-Agent-Class')").select(
        "path", F.concat(F.lit("entry:"), "key").alias("subject"), F.col("value").alias("detail"))


def _unsigned(u: DataFrame) -> DataFrame:
    signed = S.resource_rows(u).where("rule = 'signature'").select("path").distinct()
    return u.select("path").distinct().join(signed.withColumn("there", F.lit(True)), "path", "left").select(
        "path", F.lit("signature").alias("subject"), F.when(F.col("there"), "present_not_verified").otherwise("absent").alias("detail"))


def _native_exits(u: DataFrame) -> DataFrame:
    calls = S.xrefs(u).where("consumer = 'invocation'").where((F.col("owner") == F.lit(b"java/lang/System")) & F.col("name").isin(F.lit(b"exit"), F.lit(b"load"), F.lit(b"loadLibrary")))
    return calls.select("path", F.lit("process").alias("subject"), F.decode("name", "UTF-8").alias("detail"))


PLUGINS = {r.id: r for r in (Rule("services", 1, "resources", "result_items", "builtin", _providers), Rule("entry-points", 1, "resources", "result_items", "builtin", _entry_points),
                             Rule("signatures", 1, "resources", "result_items", "builtin", _unsigned), Rule("process-calls", 1, "xrefs", "result_items", "builtin", _native_exits))}
FINDING = "path string, subject string, detail string, rule string, rule_version int"


def run(u: DataFrame, wanted: list[str], rules: dict[str, Rule] = PLUGINS) -> tuple[DataFrame, dict[str, str]]:
    """(findings, the state of every known or named rule): completed, stopped, not_requested or unknown."""
    out, states = u.sparkSession.createDataFrame([], FINDING), {k: "not_requested" for k in rules}
    for name in dict.fromkeys(wanted):
        if name not in rules:
            states[name] = "unknown"
            continue
        try:
            found = rules[name].find(u).select("path", "subject", "detail").withColumns({"rule": F.lit(name), "rule_version": F.lit(rules[name].version)})
            out, states[name] = out.unionByName(settled(found, f"plugin-{name}")), "completed"  # run here, so that a broken rule stops alone
        except (PySparkException, Py4JError):
            states[name] = "stopped"
    return out, states
