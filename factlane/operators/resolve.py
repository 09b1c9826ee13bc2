"""Resolution under explicit load roots: which physical definition a name means, and what follows from that.

A load root is (loader, root_ordinal, container_id, prefix); order is data.  Selection comes first and validation second:
the first root that holds a name wins, several entries there are ambiguous, an entry whose header says another name is
refused without trying later roots, and a root whose directory could not be listed stops the search.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.request import InvalidInput
from ..sources import artifact as S
from ..sources.store import settled
from . import algebra as A

ROOT = "loader string, root_ordinal int, container_id string, prefix binary"
POLICIES = ("single_class", "plain_jar", "explicit_classpath")
PUBLIC, PRIVATE, PROTECTED, STATIC, INTERFACE, ABSTRACT = 0x0001, 0x0002, 0x0004, 0x0008, 0x0200, 0x0400


def environment(u: DataFrame, policy: str, containers: list[str] | None = None, loader: str = "app") -> DataFrame:
    """Load roots of a policy; nothing is inferred from manifests or layouts."""
    if policy not in POLICIES:
        raise InvalidInput("unsupported_policy")
    spark = u.sparkSession
    if policy == "explicit_classpath":
        if not containers:
            raise InvalidInput("no_roots")
        return spark.createDataFrame([(loader, k, c, b"") for k, c in enumerate(containers)], ROOT)
    roots = S.containers(u).where("depth = 0").select("container_id").distinct()
    if policy == "single_class":
        return spark.createDataFrame([], ROOT)
    order = Window.partitionBy(F.lit(0)).orderBy("container_id")
    return roots.select(F.lit(loader).alias("loader"), (F.row_number().over(order) - 1).alias("root_ordinal"), "container_id", F.lit(b"").alias("prefix"))


def check_loaders(parents: dict[str, str | None]) -> None:
    """Every parent must exist, and the graph must end."""
    for start in parents:
        seen, at = set(), start
        while at is not None:
            if at in seen:
                raise InvalidInput("loader_cycle")
            seen.add(at)
            if at not in parents:
                raise InvalidInput("loader_parent")
            at = parents[at]


def definitions(u: DataFrame, roots: DataFrame, names: DataFrame) -> DataFrame:
    """(name, state, def_key, root_ordinal, container_id, ordinal) for each name (binary, internal spelling).

    States: resolved, ambiguous (a row for each origin), name_mismatch, incomplete, missing.
    """
    wanted = names.select("name").distinct()
    entry = u.where("is_class_candidate").select("container_id", "raw_name", "ordinal", "def_key", "this_class")
    rooted = entry.join(roots, "container_id")
    named = rooted.withColumn("name", F.expr("substring(raw_name, length(prefix) + 1, length(raw_name) - length(prefix) - 6)")).where(
        F.expr("raw_name = concat(prefix, name, cast('.class' as binary))"))
    held = named.join(wanted, "name")
    broken = roots.join(S.containers(u).where("not directory_complete").select("container_id"), "container_id").agg(F.min("root_ordinal").alias("broken"))
    chosen = A.first_root(held, ["name"], "root_ordinal")
    told = _with_broken(wanted.join(chosen, "name", "left"), broken)
    state = (F.when(F.col("broken").isNotNull() & (F.col("root_ordinal").isNull() | (F.col("broken") <= F.col("root_ordinal"))), "incomplete")
             .when(F.col("root_ordinal").isNull(), "missing").when(F.col("n_candidates") > 1, "ambiguous")
             .when(~F.col("this_class").eqNullSafe(F.col("name")), "name_mismatch").otherwise("resolved"))
    return told.select("name", state.alias("state"), "def_key", "root_ordinal", "container_id", "ordinal", "loader")


def _with_broken(df: DataFrame, broken: DataFrame) -> DataFrame:
    first = broken.first()["broken"]
    return df.withColumn("broken", F.lit(first).cast("int"))


def hierarchy(u: DataFrame, roots: DataFrame) -> DataFrame:
    """(child, parent, kind) by definition keys: each direct supertype resolved under the roots; unresolved ones keep null."""
    c = S.classes(u)
    above = c.select("def_key", F.col("super_class").alias("name"), F.lit("extends").alias("kind")).where("name is not null").unionByName(
        c.select("def_key", F.explode("interfaces").alias("name"), F.lit("implements").alias("kind")))
    found = definitions(u, roots, above)
    edges = above.join(found.where("state = 'resolved'").select("name", F.col("def_key").alias("parent")), "name", "left")
    return settled(edges.select(F.col("def_key").alias("child"), "parent", "kind", "name"), "hierarchy")


def supertypes(u: DataFrame, roots: DataFrame, depth: int | None = 8, edges: DataFrame | None = None) -> DataFrame:
    """(root, node, depth): each definition's supertypes within ``depth`` edges, all of them where it is None; the definition itself at 0."""
    known = (hierarchy(u, roots) if edges is None else edges).where("parent is not null").select("child", "parent").distinct()
    roots_ = S.classes(u).select(F.col("def_key").alias("root")).distinct()
    if depth is not None:
        return settled(A.closure(known, roots_, depth), "supertypes")
    found = level = settled(roots_.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")), "supertypes")
    while not level.isEmpty():  # what a level reaches again is dropped, so cycles end too
        step = level.join(known.withColumnRenamed("child", "node"), "node").select("root", F.col("parent").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        level = settled(step.join(found.select("root", "node"), ["root", "node"], "left_anti"), "supertypes")
        found = found.unionByName(level)
    return found


def _most_specific(hits: DataFrame, up: DataFrame, keys: list[str]) -> DataFrame:
    """The hits without those whose interface is above another hit's of the same key."""
    above = up.where("depth > 0").select(F.col("root").alias("node"), F.col("node").alias("beaten"))
    beaten = hits.select(*keys, "node").join(above, "node").select(*keys, F.col("beaten").alias("node")).distinct()
    return hits.join(beaten, [*keys, "node"], "left_anti")


def resolve_members(u: DataFrame, roots: DataFrame, wanted: DataFrame) -> DataFrame:
    """Field and method lookup: wanted (kind, owner, name, descriptor[, caller]) to declarations on the owner's supertypes.

    Methods: the nearest class of the owner's chain, then the maximally specific of its interfaces' methods, static and private
    ones left out: the one that is not abstract, or the only one; several defaults, or several abstract methods alone, are
    ambiguous.  Fields: class by class along the chain, each before the interfaces it names.  Equal declarations of one class
    are ambiguous.  What the owner's search could not finish is incomplete, never missing.  With a caller (the internal
    name of a class) a declaration that it may not use is inaccessible: private outside the class and those named
    within it, package-private outside the package, protected outside both the package and the caller's supertypes.
    """
    base = ["kind", "owner", "name", "descriptor"]
    keys = [*base, "caller"] if "caller" in wanted.columns else base
    asked = wanted.select(*keys).distinct()
    owners = definitions(u, roots, asked.select(F.col("owner").alias("name"))).select(F.col("name").alias("owner"), F.col("state").alias("owner_state"), F.col("def_key").alias("root"))
    edges = hierarchy(u, roots)
    up = supertypes(u, roots, None, edges)
    headers = S.classes(u).select(F.col("def_key").alias("node"), "this_class", (F.col("flags").bitwiseAND(INTERFACE) != 0).alias("interface"))
    declared = S.members(u).select(F.col("def_key").alias("node"), "kind", "name", "descriptor", F.col("flags").alias("member_flags"), F.col("index").alias("member_index"))
    told = asked.select(*base).distinct().join(owners.where("owner_state = 'resolved'"), "owner").join(up, "root").join(headers, "node")
    hits = settled(told.join(declared, ["node", "kind", "name", "descriptor"]).withColumn("own", ~F.col("interface") | (F.col("depth") == 0)), "member-hits")

    nearest = Window.partitionBy(*base)
    methods = hits.where("kind = 'method'").where(F.col("own") | (F.col("member_flags").bitwiseAND(STATIC | PRIVATE) == 0))
    of_class = methods.where("own").withColumn("least", F.min("depth").over(nearest)).where("depth = least").drop("least")
    above = _most_specific(methods.where("not own").join(of_class, base, "left_anti"), up, base)
    defaults = above.where(F.col("member_flags").bitwiseAND(ABSTRACT) == 0)
    chosen = defaults.unionByName(above.join(defaults, base, "left_anti"))

    # fields: an interface counts with the first class of the chain that names it, directly or through other interfaces
    named = supertypes(u, roots, None, edges.where("kind = 'implements'")).where("depth > 0").select(F.col("root").alias("via"), "node")
    chain = told.where("kind = 'field'").where(~F.col("interface") | (F.col("depth") == 0)).select(*base, F.col("node").alias("via"), F.col("depth").alias("place"))
    fields = hits.where("kind = 'field'")
    of_chain = fields.where("own").withColumn("place", F.col("depth") * 2)
    of_named = fields.where("not own").join(chain.join(named, "via").groupBy(*base, "node").agg((F.min("place") * 2 + 1).alias("place")), [*base, "node"])
    first = of_chain.unionByName(of_named).withColumn("least", F.min("place").over(nearest)).where("place = least").drop("least", "place")

    best = of_class.unionByName(chosen).unionByName(_most_specific(first, up, base))
    best = best.groupBy(*base).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "member_index", "member_flags", "this_class")).alias("hit"))
    open_above = (up.join(edges.where("parent is null").select(F.col("child").alias("node")).distinct(), "node").select("root").distinct().withColumn("open", F.lit(True)))
    out = asked.join(owners, "owner", "left").join(best, base, "left").join(open_above, "root", "left")
    usable = F.lit(True)
    if "caller" in keys:
        callers = definitions(u, roots, asked.select(F.col("caller").alias("name"))).where("state = 'resolved'").select(F.col("name").alias("caller"), F.col("def_key").alias("caller_key"))
        may = up.select(F.col("root").alias("caller_key"), F.col("node").alias("inherited")).join(callers, "caller_key").select("caller", "inherited")
        out = out.join(may, (out["caller"] == may["caller"]) & (F.col("hit.node") == F.col("inherited")), "left").drop(may["caller"])
        flag = lambda x: F.col("hit.member_flags").bitwiseAND(x) != 0
        text = lambda c: F.decode(c, "UTF-8")
        package = lambda c: F.regexp_extract(text(c), "^(.*)/[^/]*$", 1)
        outer = lambda c: F.regexp_extract(text(c), r"^([^$]*)", 1)
        near = package(F.col("caller")) == package(F.col("hit.this_class"))
        usable = F.when(flag(PUBLIC), True).when(flag(PRIVATE), outer(F.col("caller")) == outer(F.col("hit.this_class"))).when(
            flag(PROTECTED), near | F.col("inherited").isNotNull()).otherwise(near)
    state = (F.when(F.col("owner_state") != "resolved", F.col("owner_state")).when((F.col("n") == 1) & ~usable, "inaccessible").when(F.col("n") == 1, "resolved")
             .when(F.col("n") > 1, "ambiguous").when(F.col("open"), "incomplete").otherwise("missing"))
    return out.select(*keys, state.alias("state"), "hit.node", "hit.member_index").withColumnRenamed("node", "declared_in").distinct()


def declaration_references(u: DataFrame, roots: DataFrame, kind: str, name: bytes, descriptor: bytes, declared_in: str | None = None) -> DataFrame:
    """All sites that mention (name, descriptor) under any owner, each with what its owner resolves to; unresolved ones stay."""
    sites = S.xrefs(u).where((F.col("target_kind") == kind) & (F.col("name") == F.lit(name)) & (F.col("descriptor") == F.lit(descriptor)))
    asked = sites.select(F.col("target_kind").alias("kind"), "owner", "name", "descriptor").distinct()
    told = resolve_members(u, roots, asked).select("owner", "state", "declared_in")
    out = sites.join(told, "owner", "left")
    return out if declared_in is None else out.where((F.col("declared_in") == declared_in) | (F.col("state") != "resolved"))


def subtypes(u: DataFrame, roots: DataFrame, def_key: str, depth: int | None = None) -> DataFrame:
    """(def_key, depth): the definitions strictly below one, level by level from it downwards."""
    down = hierarchy(u, roots).where("parent is not null").select(F.col("parent").alias("node"), "child").distinct()
    spark = u.sparkSession
    found = level = settled(spark.createDataFrame([(def_key, 0)], "node string, depth int"), "subtypes")
    k = 0
    while (depth is None or k < depth) and not level.isEmpty():
        k += 1
        step = level.join(down, "node").select(F.col("child").alias("node"), F.lit(k).alias("depth")).distinct()
        level = settled(step.join(found, "node", "left_anti"), "subtypes")
        found = found.unionByName(level)
    return found.where("depth > 0").select(F.col("node").alias("def_key"), "depth")


def dispatch_candidates(u: DataFrame, roots: DataFrame, def_key: str, name: bytes, descriptor: bytes, depth: int | None = None) -> DataFrame:
    """Methods of the same shape strictly below a definition; the world stays open, so never a proof of all."""
    shape = (F.col("kind") == "method") & (F.col("name") == F.lit(name)) & (F.col("descriptor") == F.lit(descriptor))
    return subtypes(u, roots, def_key, depth).join(S.members(u).where(shape), "def_key").withColumn("open_world", F.lit(True))


#: Calls whose string or class argument names a target: (owner, name, what the constant names).
REFLECTION = [("java/lang/Class", "forName", "class"), ("java/lang/Class", "getMethod", "method"), ("java/lang/Class", "getDeclaredMethod", "method"),
              ("java/lang/Class", "getField", "field"), ("java/lang/Class", "getDeclaredField", "field"), ("java/lang/invoke/MethodHandles$Lookup", "findVirtual", "method"),
              ("java/lang/invoke/MethodHandles$Lookup", "findStatic", "method"), ("java/util/ServiceLoader", "load", "service")]


def reflection_patterns(u: DataFrame) -> DataFrame:
    """Reflective calls with the constant right before them: inferred where it is one, else unknown with a reason."""
    spark = u.sparkSession
    known = spark.createDataFrame([(a.encode(), b.encode(), c) for a, b, c in REFLECTION], "owner binary, name binary, names string")
    calls = S.xrefs(u).where("consumer = 'invocation'").join(F.broadcast(known), ["owner", "name"]).select("path", "def_key", "this_class", "member_index", "bci", "owner", "name", "names")
    w = Window.partitionBy("def_key", "member_index").orderBy("bci")
    before = S.instructions(u).select("def_key", "member_index", "bci", F.lag("opcode").over(w).alias("source_opcode"), F.lag("cp_index").over(w).alias("source"))
    constants = S.pool(u).where("lit_kind = 'string' or tag = 'class'").select("def_key", F.col("cp_index").alias("source"), F.coalesce("lit_utf", "owner").alias("constant"))
    told = calls.join(before, ["def_key", "member_index", "bci"], "left").join(constants, ["def_key", "source"], "left")
    loads = F.col("source_opcode").isin(18, 19) & F.col("constant").isNotNull()
    return told.select("path", "def_key", "this_class", "member_index", "bci", "owner", "name", "names", F.when(loads, F.col("constant")).alias("target"),
                       F.when(loads, "pattern_inferred_target").otherwise("unknown").alias("state"),
                       F.when(loads, "constant_operand").when(F.col("source_opcode").isNull(), "no_source").otherwise("operand_not_constant").alias("reason"))


def callees(u: DataFrame, roots: DataFrame, def_key: str, member_index: int) -> DataFrame:
    """The bodies that one body names: each call with its physical definition and code, read for those members alone."""
    calls = S.xrefs(u.where(F.col("def_key") == def_key)).where((F.col("consumer") == "invocation") & (F.col("member_index") == member_index))
    asked = calls.select(F.lit("method").alias("kind"), "owner", "name", "descriptor").distinct()
    told = resolve_members(u, roots, asked)
    bodies = S.members(u).where("has_code").select(F.col("def_key").alias("declared_in"), F.col("index").alias("callee_index"), "code_length")
    on = (told["declared_in"] == bodies["declared_in"]) & (told["member_index"] == bodies["callee_index"])
    return told.join(bodies, on, "left").select("owner", "name", "descriptor", "state", told["declared_in"], "callee_index", "code_length")
