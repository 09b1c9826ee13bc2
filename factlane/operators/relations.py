"""Structural queries over the units of artifacts: items in physical order, and a one-row report."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.request import UNSUPPORTED, Budget, InvalidInput, Limits, Literal, QueryRequest, Symbol
from ..sources import artifact as S
from . import algebra as A

ORDER = ["path", "unit_seq", "seq"]
ITEM = [*ORDER, "snapshot_id", "container_id", "ordinal", "def_key", "this_class", "consumer", "target_kind", "owner", "name", "descriptor", "member_index", "bci", "cp_index",
        "lit_kind", "lit_bits", "lit_utf", "via", "relation", "derivation", "certainty", "resolution"]


def scoped(u: DataFrame, request: QueryRequest) -> DataFrame:
    if request.snapshot is not None:
        u = u.where(F.col("snapshot_id") == request.snapshot)
    if request.container is not None:
        u = u.where(F.col("container_id") == request.container)
    return u


def _equal(parts: dict[str, bytes | None]) -> list:
    return [F.col(k).eqNullSafe(F.lit(v)) for k, v in parts.items()]


def candidates(u: DataFrame, request: QueryRequest) -> DataFrame:
    """The rows of the request's relation; filters over binary identities, pushed to one scan of the nested column."""
    t = request.target
    if request.relation == "constant_pool_contains":
        rows = S.pool(u)
        assert isinstance(t, Symbol)
        tags = {"class": ["class"], "field": ["fieldref"], "method": ["methodref", "interface_methodref"]}[t.kind]
        rows = rows.where(reduce(and_, [F.col("tag").isin(tags), *_equal(t.parts())]))
        extra = {"consumer": "constant_pool", "target_kind": t.kind, "via": "entry", "relation": "constant_pool_contains", "derivation": "constant_pool", "certainty": "exact", "resolution": "not_resolved"}
        return rows.withColumns({k: F.lit(v) for k, v in extra.items()} | {"member_index": F.lit(-1), "bci": F.lit(-1)})
    rows = S.xrefs(u)
    if request.consumers:
        rows = A.of_kinds(rows, "consumer", request.consumers)
    if isinstance(t, Literal):
        same = [F.col("lit_kind") == t.kind, F.col("lit_bits").eqNullSafe(F.lit(t.bits)), F.col("lit_utf").eqNullSafe(F.lit(t.utf))]
        return rows.where(reduce(and_, same)).withColumn("relation", F.lit("literal_value"))
    parts = t.parts()
    if request.relation == "owner_candidates":  # a superset of every exact reference to the owner
        return rows.where(F.col("owner") == F.lit(parts["owner"]))
    if request.relation == "member_shape":  # whoever owns it; the resolver asks for these
        return rows.where(reduce(and_, [F.col("target_kind") == t.kind, *_equal({k: parts[k] for k in ("name", "descriptor")})]))
    return rows.where(reduce(and_, [F.col("target_kind") == t.kind, *_equal(parts)]))


def query(u: DataFrame, request: QueryRequest, limits: Limits | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, report).  The request and its cursor are checked before anything is read.

    has_more says that the page was full; complete says that every unit was read.  Neither implies the other.
    """
    request, limits = request.validated(), limits or Limits()
    position = request.position()
    spark = u.sparkSession
    if request.relation in UNSUPPORTED:
        empty = spark.createDataFrame([], "path string, unit_seq bigint, seq int")
        return empty, spark.createDataFrame([(request.relation, "unsupported_analysis", "not_requested", False, None, 0, 0)], REPORT)
    view = scoped(u, request)
    rows = candidates(view, request).select(*ITEM)
    sizes = [n for n in (request.max_items or None, limits.result_items) if n is not None]
    stopped = False
    if sizes:
        size = min(sizes)
        paged = A.page(rows, ORDER, size, position) if size else rows.limit(0).withColumns({"page_row": F.lit(0), "has_more": F.lit(True)})
        last = paged.orderBy(F.col("page_row").desc()).limit(1).collect()
        more = bool(last[0]["has_more"]) if last else not size and not rows.isEmpty()
        cursor = request.next_cursor(tuple(last[0][c] for c in ORDER)) if last and more else None
        stopped = more and limits.result_items is not None and size == limits.result_items
        items = paged.drop("page_row", "has_more")
    else:
        items, more, cursor = (rows.where(A.after(ORDER, position)) if position else rows), False, None
    told = S.unit_status(view).agg(F.count(F.lit(1)).alias("units"), F.count(F.when(F.col("state") == "complete", 1)).alias("read")).first()
    state = "partial" if stopped or told["units"] != told["read"] else "complete_within_schema"
    return items, spark.createDataFrame([(request.relation, "supported", state, more, cursor, told["units"], told["read"])], REPORT)


REPORT = "relation string, analysis string, state string, has_more boolean, cursor string, units bigint, units_read bigint"


def skipped(u: DataFrame) -> DataFrame:
    """The units that were not read whole, with the cause."""
    return S.unit_status(u).where("state <> 'complete'")


def usage(u: DataFrame) -> DataFrame:
    """What decoding charged: sums, but the depth, which is a high-water mark."""
    return u.groupBy("snapshot_id", "path").agg(
        F.count(F.when(F.col("container_id").isNotNull(), 1)).alias("archive_entries"), F.sum(F.coalesce("length", F.lit(0))).alias("entry_bytes"),
        F.sum(F.when(F.col("is_class_candidate"), F.coalesce("length", F.lit(0))).otherwise(0)).alias("class_bytes"),
        F.count("def_key").alias("class_headers"), F.sum(F.size(F.filter("members", lambda m: m["has_code"]))).alias("method_bodies"),
        F.sum(F.aggregate("members", F.lit(0).cast("long"), lambda a, m: a + F.coalesce(m["code_length"], F.lit(0)))).alias("code_bytes"), F.max("depth").alias("nested_depth"))


def with_usage(report: DataFrame, budget: Budget) -> DataFrame:
    """The report with what the operation has used, whatever its state; nothing else of it changes."""
    used = F.create_map(*[x for k, v in sorted(budget.used.items()) for x in (F.lit(k), F.lit(v).cast("long"))]) if budget.used else F.create_map().cast("map<string,bigint>")
    return report.withColumn("usage", used)


def ledger(u: DataFrame, limits: Limits) -> DataFrame:
    """The shared totals of all files' operations: dimension, used, limit and whether they went over it."""
    totals = usage(u).agg(*[F.max(c).alias(c) if c == "nested_depth" else F.sum(c).alias(c) for c in LEDGER])
    rows = totals.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("used"),
                                                      F.lit(getattr(limits, c)).cast("long").alias("limit")) for c in LEDGER])).alias("r")).select("r.*")
    return rows.withColumn("exceeded", F.coalesce(F.col("used") > F.col("limit"), F.lit(False)))


LEDGER = ("archive_entries", "entry_bytes", "class_bytes", "class_headers", "method_bodies", "code_bytes", "nested_depth")


def grouped_by_method(items: DataFrame) -> DataFrame:
    """Body hits by owning method; class-level hits keep a bucket of their own (member_index -1)."""
    return items.groupBy("def_key", "this_class", "member_index").agg(
        F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list(F.struct("bci", "seq", "consumer", "via"))).alias("items"))


def find_targets(u: DataFrame, spelled: str, member: str | None = None, descriptor: str | None = None) -> DataFrame:
    """All physical candidates of a dotted or internal class name; of a member, every overload."""
    name = spelled.replace(".", "/").encode()
    found = S.classes(u).where(F.col("this_class") == F.lit(name))
    if member is None:
        return found.withColumn("n_candidates", F.count(F.lit(1)).over(_whole()))
    rows = S.members(u).where((F.col("this_class") == F.lit(name)) & (F.col("name") == F.lit(member.encode())))
    return rows if descriptor is None else rows.where(F.col("descriptor") == F.lit(descriptor.encode()))


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy("this_class")


def class_view(u: DataFrame, def_key: str) -> DataFrame:
    """One definition: header, members and instructions, from one scan."""
    if not def_key:
        raise InvalidInput("definition")
    return S.classes(u.where(F.col("def_key") == def_key)).join(u.select("def_key", "members", "instructions"), "def_key")
