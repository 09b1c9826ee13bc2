"""The evidence algebra on the driver's tables: one query for each operator, with the SQL that says the same.

Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import algebra as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- 2.3 query relations ------------------------------------------------------------------------------------------
@query("mentions_symbol_exact", """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem
    WHERE (l_orderkey, l_partkey, l_suppkey) IN (SELECT (min(l_orderkey), arg_min(l_partkey, (l_orderkey, l_partkey, l_suppkey)),
        arg_min(l_suppkey, (l_orderkey, l_partkey, l_suppkey))) FROM lineitem)""")
def mentions_symbol_exact(spark, sf_dir):
    """Q02: all rows of one exact (order, part, supplier) target: the least of the table."""
    items = read(spark, sf_dir, "lineitem")
    target = items.agg(F.min(F.struct("l_orderkey", "l_partkey", "l_suppkey")).alias("t")).first()["t"]
    return A.exact(items, target.asDict()).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")


@query("owner_candidates", """
    SELECT o_orderkey, o_custkey, l_partkey, l_linenumber, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    WHERE o_custkey = (SELECT min(o_custkey) FROM orders)""")
def owner_candidates(spark, sf_dir):
    """Q06: everything that one owner holds, a superset of its exact references."""
    orders = read(spark, sf_dir, "orders")
    owner = orders.agg(F.min("o_custkey")).first()[0]
    mine = A.exact(orders, {"o_custkey": owner})
    items = read(spark, sf_dir, "lineitem")
    return mine.join(items, mine.o_orderkey == items.l_orderkey).select("o_orderkey", "o_custkey", "l_partkey", "l_linenumber", "l_extendedprice")


@query("literal_value_double", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount = 0.05::DOUBLE")
def literal_value_double(spark, sf_dir):
    """Q03: a typed constant."""
    return A.literal(read(spark, sf_dir, "lineitem"), "l_discount", 0.05).select("l_orderkey", "l_linenumber", "l_discount")


@query("unused_pool_entries", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unused_pool_entries(spark, sf_dir):
    """Q01 less Q02: entries that no consumer uses."""
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("used_pool_entries", "SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def used_pool_entries(spark, sf_dir):
    """Q02: entries with a consumer, each once."""
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left_semi")


@query("consumer_kind_filter", """
    SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events WHERE event_type IN ('click', 'purchase', 'view') GROUP BY 1""")
def consumer_kind_filter(spark, sf_dir):
    """Q08: a canonical set of kinds."""
    kinds = A.of_kinds(read(spark, sf_dir, "events"), "event_type", ["view", "click", "purchase", "click"])
    return kinds.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"))


@query("page_keyset", """
    WITH c AS (SELECT o_orderdate AS d, o_orderkey AS k FROM orders ORDER BY o_orderdate, o_orderkey OFFSET 10 LIMIT 1),
    t AS (SELECT o_orderdate, o_orderkey, o_totalprice FROM orders, c WHERE (o_orderdate, o_orderkey) > (d, k) ORDER BY 1, 2 LIMIT 51),
    n AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS page_row, count(*) OVER () > 50 AS has_more FROM t)
    SELECT o_orderdate, o_orderkey, o_totalprice, page_row, has_more FROM n WHERE page_row <= 50""")
def page_keyset(spark, sf_dir):
    """Q09: the page behind a cursor, and whether there is more."""
    orders = read(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", "o_totalprice")
    start = A.page(orders, ["o_orderdate", "o_orderkey"], 11).where("page_row = 11").first()
    cursor = (start["o_orderdate"], start["o_orderkey"])
    return A.page(orders, ["o_orderdate", "o_orderkey"], 50, cursor).withColumn("page_row", F.col("page_row").cast("long"))


@query("coverage_rollup", """
    SELECT o_orderpriority, count(*) AS units, count(*) FILTER (o_orderstatus = 'F') AS units_read,
        CASE WHEN count(*) FILTER (o_orderstatus = 'F') = count(*) THEN 'complete' WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'partial' ELSE 'unknown' END AS state
    FROM orders GROUP BY 1""")
def coverage_rollup(spark, sf_dir):
    """Q12: completeness of groups of units."""
    return A.coverage(read(spark, sf_dir, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "F")


# -- 2.4 presentation ---------------------------------------------------------------------------------------------
@query("group_by_owner", """
    SELECT o_custkey, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items
    FROM (SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders) GROUP BY 1""")
def group_by_owner(spark, sf_dir):
    """Hits of each owner, in order."""
    return A.grouped(read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey")


@query("finding_class", """
    SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'resolved_declaration' WHEN l.quality IS NOT NULL THEN 'structural_reference' ELSE 'constant_pool_candidate' END AS finding
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def finding_class(spark, sf_dir):
    """Three classes that never merge."""
    told = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return told.select("doc_id", A.finding(F.col("quality") == 1, F.col("quality").isNotNull()).alias("finding"))


@query("operation_outcome", """
    SELECT n_nationkey, count(s_suppkey) AS n, CASE WHEN n_regionkey = 4 THEN 'incomplete' WHEN count(s_suppkey) = 1 THEN 'performed'
        WHEN count(s_suppkey) > 1 THEN 'ambiguous' ELSE 'missing' END AS outcome
    FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey""")
def operation_outcome(spark, sf_dir):
    """Names bound to one, many or none; a search that isn't finished (region 4) says so."""
    nation, supplier = read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier")
    bound = nation.join(supplier, nation.n_nationkey == supplier.s_nationkey, "left").groupBy("n_nationkey", "n_regionkey").agg(F.count("s_suppkey").alias("n"))
    return bound.select("n_nationkey", "n", A.outcome(F.col("n"), F.col("n_regionkey") != 4).alias("outcome"))


# -- 2.5 resolution -----------------------------------------------------------------------------------------------
@query("ordered_root_first", """
    WITH c AS (SELECT s_nationkey AS nation, 0 AS root, s_suppkey AS key FROM supplier UNION ALL SELECT c_nationkey, 1, c_custkey FROM customer),
    f AS (SELECT *, min(root) OVER (PARTITION BY nation) AS first FROM c)
    SELECT nation, root, count(*) AS n_candidates, min(key) AS key, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'resolved' END AS state
    FROM f WHERE root = first GROUP BY 1, 2""")
def ordered_root_first(spark, sf_dir):
    """The first root that has the name wins; several candidates at its position are ambiguous."""
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit(0).alias("root"), F.col("s_suppkey").alias("key"))
    customers = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.lit(1).alias("root"), F.col("c_custkey").alias("key"))
    chosen = A.first_root(suppliers.unionByName(customers), ["nation"], "root")
    return chosen.groupBy("nation", "root").agg(F.first("n_candidates").alias("n_candidates"), F.min("key").alias("key"), F.first("state").alias("state"))


@query("ambiguous_definitions", """
    SELECT doc_id, digest, n FROM (SELECT doc_id, sha256(text) AS digest, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents) WHERE n > 1""")
def ambiguous_definitions(spark, sf_dir):
    """Equal definitions at several origins; every origin stays."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    many = docs.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return docs.join(many, "digest").select("doc_id", "digest", "n")


@query("digest_identity", "SELECT doc_id, sha256(text) AS digest, octet_length(encode(text)) AS length FROM documents")
def digest_identity(spark, sf_dir):
    """Content identity."""
    text = F.col("text").cast("binary")
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("length"))


@query("resolve_left_outer", """
    SELECT c_custkey, n_name, r_name, CASE WHEN r_regionkey IS NULL THEN 'missing' ELSE 'resolved' END AS state FROM customer
    LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_name <> 'ASIA') r ON n_regionkey = r_regionkey""")
def resolve_left_outer(spark, sf_dir):
    """Resolution that keeps what is missing."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region").where("r_name <> 'ASIA'")
    customers = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    told = customers.join(nation, "n_nationkey", "left").withColumnRenamed("n_regionkey", "r_regionkey")
    return A.resolved(told, region, ["r_regionkey"], "state").select("c_custkey", "n_name", "r_name", "state")


@query("declaration_refs", """
    SELECT l_orderkey, l_linenumber, l_partkey, c_custkey, CASE WHEN c_custkey IS NULL THEN 'unresolved' ELSE 'resolved' END AS state
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def declaration_refs(spark, sf_dir):
    """References resolved through two hops; unresolved ones stay."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("key"))
    owners = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), "c_custkey")
    return A.resolved(items.join(orders, "l_orderkey", "left"), owners, ["key"], "state", "unresolved").select("l_orderkey", "l_linenumber", "l_partkey", "c_custkey", "state")


_EDGES = "SELECT a.conv_id, a.turn AS child, b.turn AS parent FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1"


def _turns(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    id_ = lambda t: F.concat_ws(":", "conv_id", t)
    edges = turns.where("turn > 0").select(id_("turn").alias("child"), id_(F.col("turn") - 1).alias("parent"))
    return turns.select(id_("turn").alias("root")), edges


@query("hierarchy_closure_8", """
    WITH RECURSIVE turns AS (SELECT DISTINCT conv_id, turn FROM conversations),
    up AS (SELECT conv_id, turn AS start, turn AS node, 0 AS depth FROM turns
           UNION ALL SELECT conv_id, start, node - 1, depth + 1 FROM up WHERE depth < 8 AND node > 0)
    SELECT concat_ws(':', conv_id, start) AS root, concat_ws(':', conv_id, node) AS node, depth FROM up""")
def hierarchy_closure_8(spark, sf_dir):
    """Ancestors within eight steps."""
    roots, edges = _turns(spark, sf_dir)
    return A.closure(edges, roots, 8)


@query("dispatch_candidates", """
    WITH t AS (SELECT DISTINCT conv_id, turn, role FROM conversations)
    SELECT concat_ws(':', a.conv_id, a.turn) AS declared, concat_ws(':', b.conv_id, b.turn) AS candidate, a.role FROM t a
    JOIN t b ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.turn <= a.turn + 4 AND a.role = b.role""")
def dispatch_candidates(spark, sf_dir):
    """Strict descendants with the same shape, at most four levels below."""
    turns = read(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "role").distinct()
    roots, edges = _turns(spark, sf_dir)
    below = A.closure(edges, roots, 4).where("depth > 0")
    mine = turns.select(F.col("id").alias("root"), "role")
    theirs = turns.select(F.col("id").alias("node"), F.col("role").alias("above"))
    return below.join(mine, "root").join(theirs, "node").where("role = above").select(F.col("node").alias("declared"), F.col("root").alias("candidate"), "role")


# -- 2.1 selection by release, registries, resources --------------------------------------------------------------
@query("asof_level", """
    SELECT user_id, max(value) AS value, arg_max(event_id, (value, event_id)) AS event_id FROM events WHERE value <= 50 GROUP BY 1""")
def asof_level(spark, sf_dir):
    """The greatest level that a bound allows."""
    return A.level_at_most(read(spark, sf_dir, "events"), ["user_id"], "value", F.lit(50.0), "event_id")


_BANDS = [("small", 1, 9), ("medium", 10, 24), ("large", 25, 39), ("huge", 40, None)]


@query("registry_band", """
    SELECT band, count(*) AS n, round(sum(p_retailprice), 2) AS price FROM part JOIN
    (VALUES ('small', 1, 9), ('medium', 10, 24), ('large', 25, 39), ('huge', 40, NULL)) b(band, since, until)
    ON p_size >= since AND (until IS NULL OR p_size <= until) GROUP BY 1""")
def registry_band(spark, sf_dir):
    """A range lookup in a small registry."""
    bands = spark.createDataFrame(_BANDS, "band string, since int, until int")
    part = read(spark, sf_dir, "part")
    hit = part.join(F.broadcast(bands), (F.col("p_size") >= F.col("since")) & (F.col("until").isNull() | (F.col("p_size") <= F.col("until"))))
    return hit.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p_retailprice"), 2).alias("price"))


@query("runtime_matrix", """
    SELECT profile, user_id, max(value) AS value, arg_max(event_id, (value, event_id)) AS event_id FROM events
    JOIN (VALUES (10.0::DOUBLE), (50.0::DOUBLE), (100.0::DOUBLE)) p(profile) ON value <= profile GROUP BY 1, 2""")
def runtime_matrix(spark, sf_dir):
    """One scan for several profiles."""
    events = read(spark, sf_dir, "events").withColumn("profile", F.explode(F.array(*[F.lit(x) for x in (10.0, 50.0, 100.0)])))
    return A.level_at_most(events, ["profile", "user_id"], "value", F.col("profile"), "event_id")


@query("resource_extract", r"""
    SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]*)', 1) AS segment,
        regexp_extract(url, '[?&]([A-Za-z_]+)=', 1) AS query_key FROM pages""")
def resource_extract(spark, sf_dir):
    """Structured text of resources."""
    get = lambda p: F.regexp_extract("url", p, 1)
    return read(spark, sf_dir, "pages").select("page_id", get("^[a-z]+://([^/?#]+)").alias("host"), get("^[a-z]+://[^/?#]+/([^/?#]*)").alias("segment"), get("[?&]([A-Za-z_]+)=").alias("query_key"))


@query("json_metadata", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_metadata(spark, sf_dir):
    """Metadata values."""
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("descriptor_types", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
def descriptor_types(spark, sf_dir):
    """The parts of a compound name."""
    return read(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


# -- 2.6 budgets, 2.9 bulk delivery, 2.10 plugins -----------------------------------------------------------------
@query("budget_prefix", """
    SELECT doc_id, n_chars, running FROM (SELECT doc_id, n_chars, CAST(sum(n_chars) OVER (ORDER BY doc_id) AS BIGINT) AS running FROM documents) WHERE running <= 250000""")
def budget_prefix(spark, sf_dir):
    """The deterministic prefix that a budget allows."""
    return A.budget_prefix(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 250_000)


@query("highwater_usage", """
    SELECT conv_id, max(turn) AS depth, CAST(sum(length(text)) AS BIGINT) AS output FROM conversations GROUP BY 1""")
def highwater_usage(spark, sf_dir):
    """Depths are maxima, amounts are sums."""
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("depth"), F.sum(F.length("text")).alias("output"))


@query("operation_ledger", """
    SELECT o_orderpriority, count(*) AS charges, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS spent, min(o_orderkey) AS first_charge FROM orders GROUP BY 1""")
def operation_ledger(spark, sf_dir):
    """Totals of many workers, and the first charge of each dimension."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("charges"), F.sum(cents).alias("spent"), F.min("o_orderkey").alias("first_charge"))


@query("bulk_summary", """
    SELECT o_orderstatus, count(*) AS declared, count(*) FILTER (o_totalprice > 1000) AS executed,
        count(*) FILTER (o_totalprice > 1000 AND o_orderpriority <> '5-LOW') AS delivered FROM orders GROUP BY 1""")
def bulk_summary(spark, sf_dir):
    """Discovered, executed and delivered are counted apart."""
    ran = F.col("o_totalprice") > 1000
    return read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("declared"), F.count(F.when(ran, 1)).alias("executed"), F.count(F.when(ran & (F.col("o_orderpriority") != "5-LOW"), 1)).alias("delivered"))


@query("ordered_delivery", """
    SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS member_ordinal
    FROM lineitem""")
def ordered_delivery(spark, sf_dir):
    """A total order of members within their class."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(order).cast("long").alias("member_ordinal"))


_RULES = [("r1", 1, "the"), ("r1", 2, "tion"), ("r2", 1, "que"), ("r3", 1, "xyzzy")]


@query("plugin_rules", """
    SELECT rule, version, count(doc_id) AS hits FROM (VALUES ('r1', 1, 'the'), ('r1', 2, 'tion'), ('r2', 1, 'que'), ('r3', 1, 'xyzzy')) r(rule, version, needle)
    LEFT JOIN documents ON contains(text, needle) GROUP BY 1, 2""")
def plugin_rules(spark, sf_dir):
    """Versioned rules over resources; a rule without hits is reported."""
    docs = read(spark, sf_dir, "documents")
    hit = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("version"), F.contains("text", F.lit(n)).alias("hit")) for r, v, n in _RULES]))
    found = docs.select(hit.alias("r")).select("r.*").where("hit").groupBy("rule", "version").agg(F.count(F.lit(1)).alias("hits"))
    rules = spark.createDataFrame([(r, v) for r, v, _ in _RULES], "rule string, version int")
    return rules.join(found, ["rule", "version"], "left").select("rule", "version", F.coalesce("hits", F.lit(0)).alias("hits"))


@query("pattern_inferred", """
    SELECT conv_id, turn, CASE WHEN lag(role) OVER w IS NULL THEN 'unknown' WHEN lag(role) OVER w = role THEN 'unknown' ELSE 'inferred' END AS state,
        CASE WHEN lag(role) OVER w IS NULL THEN 'no_source' WHEN lag(role) OVER w = role THEN 'not_constant' ELSE 'proved' END AS reason
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""")
def pattern_inferred(spark, sf_dir):
    """Inferred targets, or unknown with a reason."""
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    told = read(spark, sf_dir, "conversations").withColumn("before", before)
    state = F.when(F.col("before").isNull() | (F.col("before") == F.col("role")), "unknown").otherwise("inferred")
    reason = F.when(F.col("before").isNull(), "no_source").when(F.col("before") == F.col("role"), "not_constant").otherwise("proved")
    return told.select("conv_id", "turn", state.alias("state"), reason.alias("reason"))


@query("segment_cover", """
    SELECT doc_id, count(*) AS segments, min(s) AS first_segment FROM documents, (VALUES (0, 500), (500, 1000), (1000, 2000), (2000, 1000000)) t(s, e)
    WHERE n_chars > s GROUP BY 1""")
def segment_cover(spark, sf_dir):
    """Which segments a text's offsets cover."""
    segments = F.filter(F.array(*[F.struct(F.lit(a).alias("s"), F.lit(b).alias("e")) for a, b in ((0, 500), (500, 1000), (1000, 2000), (2000, 1000000))]),
                        lambda x: F.col("n_chars") > x["s"])
    return (read(spark, sf_dir, "documents").select("doc_id", F.explode(segments).alias("x")).groupBy("doc_id")
            .agg(F.count(F.lit(1)).alias("segments"), F.min("x.s").alias("first_segment")))
