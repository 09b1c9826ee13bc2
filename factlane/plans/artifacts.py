"""Queries over artifacts: archives made from a rule, since the driver's tables hold none.

No SQL can read class files, but what the rule puts into them SQL can say (see ``artifact_sql``); digests, which name
definitions and containers, are shown as the places that they name.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import assembler as A
from ..operators import export, methods, plugins, relations, resolve
from ..sources import artifact as S
from ..sources.store import settled
from .artifact_sql import SQL as SQL  # noqa: PLC0414
from .request import Literal, QueryRequest, Symbol

ARCHIVES, CLASSES = 64, 40


def sample_archive(k: int, classes: int = CLASSES) -> bytes:
    """Half of the classes at the root, the rest in a nested archive; a manifest, a service and a version of the first class."""
    named = [(f"p{k}/C{i}.class", A.sample_class(f"p{k}", i, f"p{k}/C{i + 1}" if i % 5 == 0 else "java/lang/Object")) for i in range(classes)]
    inner = A.archive(named[classes // 2 :], stored=True)
    manifest = f"Manifest-Version: 1.0\r\nMain-Class: p{k}.C0\r\nMulti-Release: true\r\n\r\n".encode()
    return A.archive([("META-INF/MANIFEST.MF", manifest), (f"META-INF/services/p{k}.C0", f"p{k}.C1\n".encode()), *named[: classes // 2],
                      (f"META-INF/versions/11/p{k}/C0.class", named[0][1]), ("lib/inner.jar", inner)])


def sample_files(spark: SparkSession, archives: int = ARCHIVES) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                yield pa.RecordBatch.from_pydict({"path": [f"sample-{k:04d}.jar"], "content": [sample_archive(k)]})

    return spark.range(0, archives, 1, min(archives, 2 * spark.sparkContext.defaultParallelism)).mapInArrow(make, "path string, content binary")


def sample_units(spark: SparkSession, archives: int = ARCHIVES, wanted: tuple[str, ...] = S.FACTS) -> DataFrame:
    return S.decoded(sample_files(spark, archives), wanted=wanted)


def reflective_class(k: int) -> bytes:
    """Two calls of Class.forName: with a constant, and with an argument."""
    a = A.Assembler(f"r{k}/R")
    call = b"\xb8" + struct.pack(">H", a.pool.method("java/lang/Class", "forName", "(Ljava/lang/String;)Ljava/lang/Class;")) + b"\x57\xb1"
    a.method("known", "()V", b"\x12" + bytes([a.pool.string(f"r{k}.Target")]) + call)
    a.method("told", "(Ljava/lang/String;)V", b"\x2b" + call)
    return a.build()


def reflective_units(spark: SparkSession, archives: int = ARCHIVES) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                yield pa.RecordBatch.from_pydict({"path": [f"reflect-{k:04d}.jar"], "content": [A.archive([(f"r{k}/R.class", reflective_class(k))])]})

    return S.decoded(spark.range(0, archives, 1, min(archives, 2 * spark.sparkContext.defaultParallelism)).mapInArrow(make, "path string, content binary"))


def _plain(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, names and texts of class files as strings, numbers that are absent as -1."""
    kinds = dict(df.dtypes)
    shown = {"binary": lambda c: F.decode(c, "UTF-8"), "int": lambda c: F.coalesce(c, F.lit(-1)), "bigint": lambda c: F.coalesce(c, F.lit(-1).cast("long"))}
    return df.select(*[shown.get(kinds[c], F.col)(c).alias(c) for c in columns or df.columns])


def _items(request: QueryRequest, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    wanted = ("pool",) if request.relation == "constant_pool_contains" else ("xrefs",)
    # the units are stored once: the items, their page and the report all read them
    return lambda spark, sf_dir: _plain(relations.query(settled(sample_units(spark, wanted=wanted), "sample-units"), request)[0], *columns)


def _roots(u: DataFrame) -> DataFrame:
    return resolve.environment(u, "plain_jar")


def _places(u: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, seq): the unit that each definition is."""
    return S.classes(u).select(F.col("def_key").alias(key), F.col("unit_seq").alias(seq))


def _supertypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = settled(sample_units(spark, wanted=()), "sample-units")
    up = resolve.supertypes(u, _roots(u)).join(_places(u, "root", "root_seq").join(S.classes(u).select(F.col("def_key").alias("root"), "path"), "root"), "root")
    return up.join(_places(u, "node", "node_seq"), "node").select("path", "root_seq", "node_seq", "depth")


def _declaration_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = settled(sample_units(spark, wanted=("members", "xrefs")), "sample-units")
    refs = resolve.declaration_references(u, _roots(u), "method", b"call", b"()V").join(_places(u, "declared_in", "declared_seq"), "declared_in", "left")
    return _plain(refs, "path", "unit_seq", "this_class", "owner", "name", "descriptor", "member_index", "bci", "state", "declared_seq")


def _dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = settled(sample_units(spark, wanted=("members",)), "sample-units")
    key = S.classes(u).where(F.col("this_class") == F.lit(b"p0/C1")).orderBy("unit_seq").first()["def_key"]
    return _plain(resolve.dispatch_candidates(u, _roots(u), key, b"add", b"(II)I"), "path", "unit_seq", "this_class", "name", "descriptor", "depth", "open_world")


def _multi_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = settled(sample_units(spark, wanted=()), "sample-units")
    where = u.select("container_id", "path", "depth").distinct()
    return _plain(S.runtime_matrix(u, [8, 11]).join(where, "container_id"), "path", "depth", "ordinal", "plain_name", "variant_version", "release", "selected")


def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda x: F.get_json_object("body", f"$.{x}").alias(x)
    return export.events_of_files(sample_files(spark)).select("path", "unit_seq", "step", "member_index", "event", part("name"), part("text"), part("completion"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "artifact_entries": lambda spark, sf_dir: _plain(S.entries(sample_units(spark, wanted=())), "path", "depth", "ordinal", "name", "method", "is_dir", "is_class_candidate", "read_status",
                                                     "stop_code", "variant_version"),
    "artifact_classes": lambda spark, sf_dir: _plain(S.classes(sample_units(spark, wanted=())), "path", "unit_seq", "ordinal", "name", "variant_version", "major", "minor", "flags",
                                                     "this_class", "super_class", "class_state", "name_binding"),
    "artifact_members": lambda spark, sf_dir: _plain(S.members(sample_units(spark, wanted=("members",))), "path", "unit_seq", "this_class", "kind", "index", "flags", "name", "descriptor",
                                                     "has_code", "code_length"),
    "artifact_instructions": lambda spark, sf_dir: _plain(S.instructions(sample_units(spark, wanted=("instructions",))), "path", "unit_seq", "this_class", "member_index", "bci", "opcode", "width"),
    "artifact_xref": _items(QueryRequest("owner_candidates", Symbol("class", "p7/C3")), "path", "unit_seq", "this_class", "consumer", "target_kind", "owner", "name", "descriptor", "member_index",
                            "bci", "via"),
    "artifact_mentions": _items(QueryRequest("mentions_symbol", Symbol("method", "p7/C3", "<init>", "()V")), "path", "unit_seq", "this_class", "owner", "name", "descriptor", "member_index", "bci"),
    "artifact_pool": _items(QueryRequest("constant_pool_contains", Symbol("method", "never/Used", "atAll", "()V")), "path", "unit_seq", "this_class", "owner", "name", "descriptor"),
    "artifact_literal": _items(QueryRequest("literal_value", Literal("string", utf=b"text 3")), "path", "unit_seq", "this_class", "member_index", "bci", "lit_utf"),
    "artifact_page": _items(QueryRequest("member_shape", Symbol("method", None, "call", "()V"), max_items=50), "path", "unit_seq", "this_class", "owner", "name", "descriptor", "member_index", "bci"),
    "artifact_resources": lambda spark, sf_dir: S.resource_rows(sample_units(spark, wanted=())).select("path", "unit_seq", "rule", "key", "value"),
    "artifact_multi_release": _multi_release,
    "artifact_coverage": lambda spark, sf_dir: S.unit_status(sample_units(spark)).select("path", "depth", "ordinal", "name", "is_class_candidate", "state", "code"),
    "artifact_usage": lambda spark, sf_dir: relations.usage(sample_units(spark, wanted=("members",))).select(
        "path", "archive_entries", "class_headers", "method_bodies", "code_bytes", "nested_depth"),
    "artifact_supertypes": _supertypes,
    "artifact_declaration_refs": _declaration_refs,
    "artifact_dispatch": _dispatch,
    "artifact_reflection": lambda spark, sf_dir: _plain(resolve.reflection_patterns(reflective_units(spark)), "path", "this_class", "member_index", "bci", "owner", "name", "names", "target", "state",
                                                        "reason"),
    "artifact_analysis": lambda spark, sf_dir: _plain(methods.analyze(sample_units(spark)), "path", "unit_seq", "this_class", "member_index", "name", "descriptor", "state", "code"),
    "artifact_recover": lambda spark, sf_dir: _plain(methods.recover(sample_units(spark)), "path", "unit_seq", "this_class", "member_index", "name", "descriptor", "representation", "quality",
                                                     "reason", "text"),
    "artifact_export": _export,
    "artifact_plugins": lambda spark, sf_dir: plugins.run(sample_units(spark), list(plugins.PLUGINS))[0],
}
