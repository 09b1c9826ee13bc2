import glob
import json
import os
import struct
import sys
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from factlane.functions import assembler as A
from factlane.functions import classfile as C
from factlane.functions import dataflow as D
from factlane.functions import modern
from factlane.functions import recover as R
from factlane.functions import registry
from factlane.operators import export, methods, plugins, relations, resolve
from factlane.plans import artifacts, request
from factlane.plans.request import Budget, BudgetExceeded, InvalidInput, Limits, Literal, QueryRequest, Symbol
from factlane.sources import artifact as S
from factlane.sources.store import FactsStore


def u2(n):
    return struct.pack(">H", n)


@pytest.fixture(scope="module")
def units(spark):
    return S.decoded(artifacts.sample_files(spark, 3)).persist()


def files(spark, **named):
    return S.decoded(spark.createDataFrame([(k, v) for k, v in named.items()], "path string, content binary")).persist()


# -- decoding -------------------------------------------------------------------------------------------------------
def test_header_and_members():
    f = C.decode(A.sample_class("p", 3))
    assert (f.state, f.major, f.this, f.super) == ("complete", 52, b"p/C3", b"java/lang/Object")
    assert [(m.kind, m.name) for m in f.members] == [("field", b"count"), ("method", b"<init>"), ("method", b"add"), ("method", b"call"), ("method", b"run")]


def test_strict_and_forensic_headers():
    good = A.sample_class("p", 0)
    assert C.decode(good, strict=True).this == b"p/C0"
    twice = A.Assembler("p/T")
    twice.field("a", "I")
    twice.field("a", "I")
    flags = A.Assembler("p/F", flags=0x411)
    for data, code in ((good[:60], None), (twice.build(), "member_twice"), (flags.build(), "class_flags"), (cls("p/N", None), "no_superclass")):
        C.decode(data)
        with pytest.raises(C.Damaged) as e:
            C.decode(data, strict=True)
        assert code in (None, e.value.code)


def test_instruction_widths_of_finally_code():
    """The published (bci, opcode, width) of a compiled try/finally."""
    old = bytes.fromhex("1b0460" "3605" "a80005" "1505" "ac" "4e" "a80003" "2d" "bf" "4d" "840101" "a902")
    c = C.Cursor(old)
    got = []
    while c.at < c.end:
        i = C._instruction(c, 0)
        got.append((i.bci, i.opcode, i.width))
    assert got == [(0, 0x1B, 1), (1, 0x04, 1), (2, 0x60, 1), (3, 0x36, 2), (5, 0xA8, 3), (8, 0x15, 2), (10, 0xAC, 1), (11, 0x4E, 1), (12, 0xA8, 3), (15, 0x2D, 1),
                   (16, 0xBF, 1), (17, 0x4D, 1), (18, 0x84, 3), (21, 0xA9, 2)]


def test_switches_wide_and_damage():
    table = b"\xaa" + b"\0\0\0" + struct.pack(">iii", 20, 1, 2) + struct.pack(">ii", 21, 22)
    i = C._instruction(C.Cursor(table), 0)
    assert (i.width, i.keys, i.targets) == (24, (1, 2), (20, 21, 22))
    look = b"\x00\xab\0\0" + struct.pack(">ii", 9, 1) + struct.pack(">ii", -5, 7)
    c = C.Cursor(look)
    C._instruction(c, 0)
    i = C._instruction(c, 0)
    assert (i.width, i.keys, i.targets) == (19, (-5,), (10, 8))
    i = C._instruction(C.Cursor(b"\xc4\x84\x01\x00\x00\x05"), 0)
    assert (i.width, i.value, i.local) == (6, 132, 256)
    data = A.sample_class("p", 1)
    for n in range(0, len(data), 7):
        assert C.decode(data[:n]).state in ("partial", "damaged")
    a = A.Assembler("x/Y")
    a.method("m", "()V", b"\x00\xff\xb1")
    f = C.decode(a.build())
    body = C.code(f, f.members[0])
    assert (body.state, body.code, [i.opcode for i in body.instructions]) == ("partial", "unknown_opcode", [0])


def test_signatures():
    assert C.erasure_matches(b"<T::Ljava/lang/Comparable<TT;>;>(TT;[TT;Ljava/util/Map<*-TT;>.Entry;I)V^TT;", b"(Ljava/lang/Comparable;[Ljava/lang/Comparable;Ljava/util/Map$Entry;I)V")
    assert not C.erasure_matches(b"(TT;)V", b"(I)V")
    assert not C.erasure_matches(b"(Lbroken", b"(I)V")
    assert C.arguments(b"(I[[JLa/B;D)[La/C;") == ([b"I", b"[[J", b"La/B;", b"D"], b"[La/C;")
    for bad in (b"I", b"(", b"(Q)V", b"(La)V", b"()VV"):
        with pytest.raises(C.Damaged):
            C.arguments(bad)


def rich_class():
    """A class with annotations, nested condy arguments, literals of every kind, a module-like set of attributes and handlers."""
    a = A.Assembler("r/Rich", interfaces=("r/I",))
    p = a.pool
    ann = u2(p.utf8("Lr/Ann;")) + u2(1) + u2(p.utf8("v")) + b"[" + u2(2) + b"c" + u2(p.utf8("Lr/InAnn;")) + b"e" + u2(p.utf8("Lr/E;")) + u2(p.utf8("A"))
    visible = a.attribute("RuntimeVisibleAnnotations", u2(1) + ann)
    a.field("f", "Lr/FieldType;", attributes=(a.attribute("Signature", u2(p.utf8("Ljava/util/List<Lr/Arg;>;"))), visible))
    handle = p.put(C.METHOD_HANDLE, 6, p.method("r/Boot", "make", "(I)V"))
    target = p.put(C.METHOD_HANDLE, 6, p.method("r/Target", "lambda", "()V"))
    kind = p.put(C.METHOD_TYPE, p.utf8("(Lr/Mt;)V"))
    condy = p.put(C.DYNAMIC, 1, p.pair("c", "Lr/Condy;"))
    site = p.put(C.INVOKE_DYNAMIC, 0, p.pair("run", "()Lr/Fn;"))
    a.attributes.append(a.attribute("BootstrapMethods", u2(3) + u2(handle) + u2(3) + u2(target) + u2(kind) + u2(condy) + u2(handle) + u2(1) + u2(p.string("arg")) + u2(handle) + u2(0)))
    a.attributes.append(a.attribute("InnerClasses", u2(1) + u2(p.cls("r/Rich$In")) + u2(a.this) + u2(0) + u2(1)))
    a.attributes.append(a.attribute("NestMembers", u2(1) + u2(p.cls("r/Rich$In"))))
    comp = u2(p.utf8("c")) + u2(p.utf8("Lr/Comp;")) + u2(1) + a.attribute("RuntimeInvisibleAnnotations", u2(1) + u2(p.utf8("Lr/OnComponent;")) + u2(0))
    a.attributes.append(a.attribute("Record", u2(1) + comp))
    in_code = a.attribute("RuntimeVisibleTypeAnnotations", u2(1) + b"\x44" + u2(0) + b"\0" + u2(p.utf8("Lr/InCode;")) + u2(0))
    code = (b"\xba" + u2(site) + b"\0\0" + b"\x57" + b"\x12" + bytes([p.put(C.INTEGER, -7)]) + b"\x57" + b"\x14" + u2(p.put(C.DOUBLE, struct.unpack(">Q", struct.pack(">d", -0.0))[0]))
            + b"\x58" + b"\x13" + u2(p.cls("[[Lr/Elem;")) + b"\x57" + b"\xb1" + b"\x57\xb1")
    a.method("m", "()V", code, handlers=((0, len(code) - 2, len(code) - 2, p.cls("r/Oops")),), inside=(in_code,),
             attributes=(a.attribute("Exceptions", u2(1) + u2(p.cls("r/Thrown"))),))
    return a.build()


def test_consumers(spark):
    u = files(spark, rich=rich_class())
    rows = S.xrefs(u).collect()
    have = {(r.consumer, r.target_kind, (r.owner or b"").decode(), r.via) for r in rows}
    for want in [("type", "class", "java/lang/Object", "super"), ("type", "class", "r/I", "interface"), ("annotation", "class", "r/Ann", "field:RuntimeVisibleAnnotations"),
                 ("annotation", "class", "r/InAnn", "field:RuntimeVisibleAnnotations"), ("annotation", "class", "r/E", "field:RuntimeVisibleAnnotations"),
                 ("annotation", "class", "r/OnComponent", "record_component:RuntimeInvisibleAnnotations"), ("annotation", "class", "r/InCode", "code:RuntimeVisibleTypeAnnotations"),
                 ("signature", "class", "r/Arg", "field"), ("inner_nest", "class", "r/Rich$In", "InnerClasses"), ("inner_nest", "class", "r/Rich$In", "NestMembers"),
                 ("exception", "class", "r/Oops", "catch"), ("exception", "class", "r/Thrown", "throws"), ("bootstrap", "method", "r/Boot", "bootstrap_handle"),
                 ("bootstrap", "method", "r/Target", "argument_handle"), ("bootstrap", "class", "r/Mt", "method_type"), ("type", "class", "r/Fn", "descriptor"),
                 ("type", "class", "r/Condy", "descriptor"), ("type", "class", "r/Elem", "class_constant"), ("type", "class", "r/Comp", "record_component")]:
        assert want in have, want
    assert not u.first()["problems"]
    literals = {(r.lit_kind, r.lit_bits, r.lit_utf) for r in rows if r.target_kind == "literal"}
    assert literals == {("int", -7, None), ("double", -(1 << 63), None), ("string", None, b"arg")}
    items, _ = relations.query(u, QueryRequest("literal_value", Literal("double", bits=0)))
    assert items.count() == 0  # 0.0 is not -0.0
    items, _ = relations.query(u, QueryRequest("literal_value", Literal("double", bits=-(1 << 63))))
    assert items.count() == 1


def test_modern_facts(spark):
    f = C.decode(rich_class())
    told = modern.dynamic_graph(f)
    assert told["state"] == "complete" and not told["cycles"] and len(told["edges"]) == 1 and sorted(told["reach"].values()) == [0, 1]
    rows = {(r.fact, r.name) for r in S.modern_facts(files(spark, rich=rich_class())).collect()}
    assert rows == {("record_component", b"c"), ("NestMembers", b"r/Rich$In")}
    a = A.Assembler("x/Cycle")
    p = a.pool
    handle = p.put(C.METHOD_HANDLE, 6, p.method("x/B", "b", "()V"))
    one, two = p.put(C.DYNAMIC, 0, p.pair("a", "I")), p.put(C.DYNAMIC, 1, p.pair("b", "I"))
    a.attributes.append(a.attribute("BootstrapMethods", u2(2) + u2(handle) + u2(1) + u2(two) + u2(handle) + u2(1) + u2(one)))
    a.method("m", "()V", b"\x12" + bytes([one]) + b"\x57\xb1")
    assert modern.dynamic_graph(C.decode(a.build()))["cycles"] == [one, two]
    assert files(spark, c=a.build()).first()["problems"] == ["condy_cycle"]


# -- archives -------------------------------------------------------------------------------------------------------
def test_duplicates_nesting_damage(spark):
    one = A.sample_class("p", 0)
    inner = A.archive([("p/C1.class", A.sample_class("p", 1)), ("deep.jar", A.archive([("p/C2.class", one)]))])
    whole = A.archive([("p/C0.class", one), ("p/C0.class", one), ("wrong.class", one), (".class", b"\xca\xfe\xba\xbe\0"), ("X.CLASS", one), ("in.jar", inner), ("note.txt", b"hi")])
    broken = bytearray(whole)
    at = broken.find(b"in.jar") + 40
    broken[at] ^= 0xFF
    u = files(spark, whole=whole, broken=bytes(broken), junk=b"PK\x03\x04 not a zip", other=b"plain", alone=one)
    rows = u.collect()
    mine = sorted([r for r in rows if r.path == "whole"], key=lambda r: r.unit_seq)
    assert [r.unit_seq for r in mine] == list(range(len(mine)))
    assert [r.name for r in mine] == ["p/C0.class", "p/C0.class", "wrong.class", ".class", "X.CLASS", "in.jar", "p/C1.class", "deep.jar", "p/C2.class", "note.txt"]
    assert [r.is_class_candidate for r in mine] == [True, True, True, True, False, False, True, False, True, False]
    assert mine[0].digest == mine[1].digest and mine[0].def_key != mine[1].def_key
    assert [r.name_binding for r in mine[:3]] == ["path_name_agrees", "path_name_agrees", "path_name_differs"]
    assert mine[3].class_state == "partial" and mine[8].depth == 2
    states = {(r.path, r.read_status, r.stop_code) for r in rows}
    assert ("junk", "damaged", "directory_unreadable") in states and ("other", "unsupported", "unknown_root") in states
    assert any(r.path == "broken" and r.read_status == "damaged" for r in rows)
    alone = next(r for r in rows if r.path == "alone")
    assert alone.container_id is None and alone.name_binding == "standalone_root"
    shallow = S.decoded(spark.createDataFrame([("w", whole)], "path string, content binary"), 0).collect()
    assert {r.stop_code for r in shallow if r.name == "in.jar"} == {"nested_depth"}
    _, report = relations.query(u, QueryRequest("mentions_symbol", Symbol("class", "p/C1")))
    assert report.first()["state"] == "partial"
    assert S.containers(u.where("path = 'junk'")).first()["directory_complete"] is False


def test_data_source_and_store(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"s{k}.jar").write_bytes(artifacts.sample_archive(k, 4))
    spark.dataSource.register(S.ArtifactSource)
    direct = S.units(spark, str(tmp_path)).count()
    assert spark.read.format("artifact").load(str(tmp_path)).count() == direct
    store = FactsStore(f"file://{tmp_path}-facts")
    cold, warm = store.units(spark, str(tmp_path)), store.units(spark, str(tmp_path))
    assert store.counters == {"consultations": 2, "hits": 1, "misses": 1, "refused": 0}
    plain = lambda df: sorted(map(str, S.xrefs(df).drop("path").collect()))
    assert plain(cold) == plain(warm) == plain(S.units(spark, str(tmp_path)))
    (tmp_path / "s2.jar").write_bytes(artifacts.sample_archive(2, 4))
    assert store.units(spark, str(tmp_path)).count() > direct and store.counters["misses"] == 2
    os.utime(tmp_path / "s1.jar", (1, 1))
    (tmp_path / "copy.jar").write_bytes(artifacts.sample_archive(1, 4))
    both = store.units(spark, str(tmp_path))
    assert store.counters["misses"] == 2 and plain(both) == plain(S.units(spark, str(tmp_path)))
    (tmp_path / "s0.jar").write_bytes(artifacts.sample_archive(7, 4))  # the same size, in the same second
    assert plain(store.units(spark, str(tmp_path))) == plain(S.units(spark, str(tmp_path))) and store.counters["misses"] == 3
    small = FactsStore(f"file://{tmp_path}-small", capacity=len(artifacts.sample_archive(1, 4)) * 2 + 200)
    for _ in range(2):
        assert plain(small.units(spark, str(tmp_path))) == plain(S.units(spark, str(tmp_path)))
    assert small.counters["refused"] == 2 and small.counters["misses"] == 2


def test_budgets_stop_the_walk():
    """Each dimension is charged before the work: what came before is kept, and the row that was stopped says why."""
    classes = [(f"p/C{k}.class", A.sample_class("p", k)) for k in range(4)]
    bomb = A.archive([*classes[:2], ("bomb.bin", b"\0" * 50_000_000), *classes[2:]])
    assert len(bomb) < 100_000
    started = time.process_time()
    got = list(S.walk("b", bomb, limits=Limits(entry_bytes=1_000_000)))
    assert time.process_time() - started < 1 and [u["name"] for u in got] == ["p/C0.class", "p/C1.class", "bomb.bin"]
    assert (got[-1]["read_status"], got[-1]["stop_code"]) == ("stopped", "budget_exceeded") and got[-1]["problems"][0].startswith("entry_bytes: ")
    nested = A.archive([("in.jar", A.archive(classes)), ("after.txt", b"x")])
    size = len(classes[0][1])
    for limits, names in ((Limits(archive_entries=3), 4), (Limits(class_bytes=2 * size), 4), (Limits(class_headers=1), 3), (Limits(method_bodies=5), 3), (Limits(code_bytes=40), 3),
                          (Limits(attribute_bytes=1), 2), (Limits(read_bytes=1), 1), (Limits(input_bytes=10), 1)):
        units = list(S.walk("n", nested, limits=limits))
        assert len(units) == names and units[-1]["read_status"] == "stopped", (limits, [(u["name"], u["read_status"]) for u in units])
        assert all(u["read_status"] == "read" for u in units[:-1])
    assert [u["stop_code"] for u in S.walk("n", nested, limits=Limits(nested_depth=0))] == ["nested_depth", None]
    assert [u["read_status"] for u in S.walk("n", nested, limits=Limits())] == ["read"] * 6


def test_an_honest_prefix_of_a_cut_archive():
    whole = A.archive([(f"p/C{k}.class", A.sample_class("p", k)) for k in range(4)])
    cut = whole[: whole.find(b"p/C3.class") + 30]
    units = list(S.walk("c", cut))
    assert [(u["name"], u["read_status"], u["class_state"]) for u in units[:-1]] == [(f"p/C{k}.class", "read", "complete") for k in range(3)]
    assert (units[-1]["ordinal"], units[-1]["stop_code"]) == (-1, "directory_unreadable") and units[-1]["problems"][1] == f"skipped: {whole.find(b'p/C3.class') - 30}-{len(cut)}"


def test_listing_and_directed_reads_decode_nothing_else(spark, monkeypatch):
    data = artifacts.sample_archive(0, 6)
    seen, decode = [], C.decode
    monkeypatch.setattr(C, "decode", lambda x: seen.append(1) or decode(x))
    names = [(u["name"], u["depth"]) for u in S.walk("a", data)]
    assert len(seen) == 7
    assert [(u["name"], u["depth"]) for u in S.walk("a", data, wanted=None)] == names and len(seen) == 7
    mine = [u for u in S.walk("a", data, names=frozenset([b"p0/C4.class"])) if u["read_status"] != "listed"]
    assert [(u["name"], u["depth"], u["this_class"]) for u in mine] == [("p0/C4.class", 1, b"p0/C4")] and len(seen) == 8
    first = next(S.walk("a", data, wanted=()))  # on demand: nothing behind it is read
    assert first["name"] == "META-INF/MANIFEST.MF" and len(seen) == 8
    df = spark.createDataFrame([("a", data)], "path string, content binary")
    assert S.directed(df, [b"p0/C4.class"]).count() == 1 and S.listed(df).count() == len(names)


def test_root_bytes(spark, tmp_path):
    (tmp_path / "x.class").write_bytes(A.sample_class("p", 0))
    budget = Budget(Limits(output_bytes=0))
    with pytest.raises(BudgetExceeded):
        S.root_bytes(spark, str(tmp_path / "x.class"), budget)
    assert S.root_bytes(spark, str(tmp_path / "x.class"), Budget()) == A.sample_class("p", 0)


def test_streaming_ingest(spark, tmp_path):
    from factlane.streaming.ingest import ingest

    folder, facts = tmp_path / "in", str(tmp_path / "facts")
    folder.mkdir()
    for k in range(3):
        (folder / f"s{k}.jar").write_bytes(artifacts.sample_archive(k, 4))
        ingest(spark, str(folder), facts, str(tmp_path / "cp")).awaitTermination(60)
    got = spark.read.schema(S.SCHEMA).parquet(facts)
    assert got.count() == S.units(spark, str(folder)).count()


def test_multi_release(spark):
    one = A.sample_class("p", 0)
    names = ["p/C0.class", "META-INF/versions/9/p/C0.class", "META-INF/versions/11/p/C0.class", "META-INF/versions/x/p/C0.class"]
    manifest = ("META-INF/MANIFEST.MF", b"Multi-Release: TRUE\n\n")
    u = files(spark, multi=A.archive([manifest, *[(n, one) for n in names]]), plain=A.archive([(n, one) for n in names]))
    paths = {r.snapshot_id: r.path for r in S.snapshots(u).collect()}
    got = {(paths[r.snapshot_id], r.release, r.variant_version) for r in S.runtime_matrix(u, [8, 10, 17]).collect() if r.selected and r.plain_name == "p/C0.class"}
    assert got == {("multi", 8, None), ("multi", 10, 9), ("multi", 17, 11), ("plain", 8, None), ("plain", 10, None), ("plain", 17, None)}


# -- queries --------------------------------------------------------------------------------------------------------
def test_unused_entries_are_no_references(units):
    symbol = Symbol("method", "never/Used", "atAll", "()V")
    assert relations.query(units, QueryRequest("mentions_symbol", symbol))[0].count() == 0
    assert relations.query(units, QueryRequest("constant_pool_contains", symbol))[0].count() == S.classes(units).count()


def test_owner_is_a_superset(units):
    keys = lambda r: {tuple(x) for x in relations.query(units, r)[0].select("path", "unit_seq", "seq").collect()}
    owner = keys(QueryRequest("owner_candidates", Symbol("class", "p1/C2")))
    for s in (Symbol("class", "p1/C2"), Symbol("method", "p1/C2", "<init>", "()V"), Symbol("field", "p1/C2", "count", "I")):
        exact = keys(QueryRequest("mentions_symbol", s))
        assert exact and exact < owner


def test_pages_are_order_stable(units):
    base = QueryRequest("member_shape", Symbol("method", None, "<init>", "()V"), consumers=("invocation",))
    whole = [tuple(r) for r in relations.query(units, base)[0].orderBy(*relations.ORDER).select(*relations.ORDER).collect()]
    got, cursor = [], None
    while True:
        items, report = relations.query(units.repartition(3), request.replace(base, max_items=50, cursor=cursor))
        told = report.first()
        got += sorted(tuple(r) for r in items.select(*relations.ORDER).collect())
        cursor = told["cursor"]
        assert told["state"] == "complete_within_schema"
        if not told["has_more"]:
            break
    assert got == whole and len(whole) > 100
    with pytest.raises(InvalidInput, match="query_cursor_mismatch"):
        relations.query(units, request.replace(base, consumers=(), cursor=relations.query(units, request.replace(base, max_items=5))[1].first()["cursor"]))
    with pytest.raises(InvalidInput, match="query_cursor_malformed"):
        relations.query(units, request.replace(base, cursor="zzz"))


def test_limits_and_unsupported(units):
    base = QueryRequest("mentions_symbol", Symbol("class", "java/lang/Object"))
    items, report = relations.query(units, base, Limits(result_items=0))
    assert items.count() == 0 and tuple(report.first()[c] for c in ("state", "has_more")) == ("partial", True)
    for relation in request.UNSUPPORTED:
        items, report = relations.query(units, request.replace(base, relation=relation))
        assert items.count() == 0 and report.first()["analysis"] == "unsupported_analysis"
    for bad in ({"relation": "x"}, {"consumers": ("x",)}, {"max_items": -1}, {"consumer_version": 9}, {"relation": "literal_value"}):
        with pytest.raises(InvalidInput):
            relations.query(units, request.replace(base, **bad))
    assert QueryRequest("mentions_symbol", base.target, consumers=("type", "field", "type")).identity() == QueryRequest("mentions_symbol", base.target, consumers=("field", "type")).identity()


def test_budget():
    b = Budget(Limits(read_bytes=10, nested_depth=3))
    b.charge("read_bytes", 6)
    b.charge("nested_depth", 3)
    b.charge("nested_depth", 2)
    with pytest.raises(BudgetExceeded) as e:
        b.charge("read_bytes", 5)
    assert (e.value.limit, e.value.consumed, e.value.requested) == (10, 6, 5) and b.used == {"read_bytes": 6, "nested_depth": 3}
    b.cancel()
    with pytest.raises(InterruptedError):
        b.charge("read_bytes", 99)
    with pytest.raises(InvalidInput):
        Limits().override(nonsense=1)


def test_operations_share_a_ledger():
    """Two walks on one ledger: the second's charge is refused by the sum, the first refusal stops both; cancelling ends a walk."""
    data = A.archive([(f"p/C{k}.class", A.sample_class("p", k)) for k in range(4)])
    shared = Budget(Limits(class_headers=6))
    one, two = shared.child(), shared.child(Limits(class_headers=5))
    assert [u["read_status"] for u in S.walk("a", data, budget=one)] == ["read"] * 4
    assert [u["read_status"] for u in S.walk("b", data, budget=two)] == ["read", "read", "stopped"]
    assert shared.used["class_headers"] == 6 and two.used["class_headers"] == 2 and shared.first_stop.dimension == "class_headers"
    with pytest.raises(BudgetExceeded):
        one.charge("read_bytes", 1)
    third, rows = Budget(), []
    for u in S.walk("c", data, budget=third):
        rows.append(u["stop_code"])
        third.cancel()
    assert rows == [None, "cancelled"]


def test_usage_and_ledger_rows(spark, units):
    report = spark.createDataFrame([("partial",)], "state string")
    budget = Budget()
    budget.charge("class_headers", 3)
    assert relations.with_usage(report, budget).first().asDict() == {"state": "partial", "usage": {"class_headers": 3}}
    assert relations.with_usage(report, Budget()).first()["usage"] == {}
    got = {r.dimension: (r.used, r.exceeded) for r in relations.ledger(units, Limits(class_headers=100, nested_depth=1)).collect()}
    assert got["class_headers"] == (123, True) and got["nested_depth"] == (1, False) and got["method_bodies"] == (492, False)


def test_observations_and_evidence(units):
    seen = {r.stage: (r.starts, r.completions) for r in methods.observations(methods.analyze(units)).collect()}
    assert seen == {s: (492, 492) for s in methods.STAGES}
    bare = methods.recover(units, ()).limit(3).collect()
    assert "details" not in bare[0].asDict() and all(not r.segments for r in bare)
    full = methods.recover(units, methods.EVIDENCE).where("member_index = 3").first()
    assert full.segments and set(full.details) == set(methods.EVIDENCE) - {"source_map"} and any(">" in x for x in full.details["region_details"])
    with pytest.raises(InvalidInput):
        methods.recover(units, ("rumours",))


def test_targets_and_grouping(units):
    assert relations.find_targets(units, "p1.C3").count() == relations.find_targets(units, "p1/C3").count() == 1
    assert relations.find_targets(units, "p0.C0").count() == 2  # the base and the versioned entry
    assert {r.descriptor for r in relations.find_targets(units, "p1.C3", "add").collect()} == {b"(II)I"}
    hits = relations.query(units, QueryRequest("owner_candidates", Symbol("class", "java/lang/Object")))[0]
    grouped = relations.grouped_by_method(hits)
    assert {r.member_index for r in grouped.collect()} == {-1, 1} and grouped.agg(F.sum("n_items")).first()[0] == hits.count()


# -- resolution -----------------------------------------------------------------------------------------------------
def cls(name, above="java/lang/Object", interfaces=(), methods_=(), flags=0x21):
    a = A.Assembler(name, above, interfaces, flags=flags)
    for m in methods_:
        a.method(m, "()V", b"\xb1")
    return a.build()


def test_ordered_roots(spark):
    left = A.archive([("a/A.class", cls("a/A")), ("a/B.class", cls("a/Other")), ("a/D.class", cls("a/D")), ("a/D.class", cls("a/D"))])
    right = A.archive([("a/A.class", cls("a/A", methods_=("x",))), ("a/B.class", cls("a/B")), ("a/C.class", cls("a/C")), ("pre/a/E.class", cls("a/E"))])
    u = files(spark, left=left, right=right, junk=b"PK\x03\x04 junk")
    ids = {r.path: r.container_id for r in u.where("depth = 0").select("path", "container_id").distinct().collect()}
    names = spark.createDataFrame([(n.encode(),) for n in ("a/A", "a/B", "a/C", "a/D", "a/E", "a/None")], "name binary")

    def state(order):
        rows = resolve.definitions(u, resolve.environment(u, "explicit_classpath", [ids[x] for x in order]), names).collect()
        return {(r.name.decode(), r.state, r.root_ordinal) for r in rows}

    assert state(["left", "right"]) == {("a/A", "resolved", 0), ("a/B", "name_mismatch", 0), ("a/C", "resolved", 1), ("a/D", "ambiguous", 0), ("a/E", "missing", None), ("a/None", "missing", None)}
    assert ("a/B", "resolved", 0) in state(["right", "left"])
    assert state(["left", "junk", "right"]) >= {("a/A", "resolved", 0), ("a/C", "incomplete", 2), ("a/None", "incomplete", None)}
    prefixed = spark.createDataFrame([("app", 0, ids["right"], b"pre/")], resolve.ROOT)
    assert {(r.name, r.state) for r in resolve.definitions(u, prefixed, names).collect()} >= {(b"a/E", "resolved"), (b"a/A", "missing")}
    with pytest.raises(InvalidInput):
        resolve.environment(u, "layout")
    with pytest.raises(InvalidInput, match="loader_cycle"):
        resolve.check_loaders({"a": "b", "b": "a"})
    resolve.check_loaders({"a": "b", "b": None})


def test_hierarchy_dispatch_and_members(spark):
    chain = [(f"h/H{i}.class", cls(f"h/H{i}", f"h/H{i - 1}" if i else None, methods_=("top",) if i == 0 else ("mid",) if i == 4 else ())) for i in range(12)]
    two = [("h/I.class", cls("h/I", "h/H0", methods_=("both",), flags=0x601)), ("h/J.class", cls("h/J", "h/H0", methods_=("both",), flags=0x601)),
           ("h/K.class", cls("h/K", "h/H0", ("h/I", "h/J"))), ("h/Open.class", cls("h/Open", "far/Away"))]
    caller = A.Assembler("h/Caller", "h/H0")
    caller.method("go", "()V", b"\x01\xb6" + u2(caller.pool.method("h/H6", "mid", "()V")) + b"\x01\xb6" + u2(caller.pool.method("no/Where", "mid", "()V")) + b"\xb1")
    u = files(spark, h=A.archive([*chain, *two, ("h/Caller.class", caller.build())]))
    roots = resolve.environment(u, "plain_jar")
    name = {r.def_key: r.this_class.decode() for r in S.classes(u).collect()}
    up = {(name[r.root], name[r.node], r.depth) for r in resolve.supertypes(u, roots).collect()}
    assert ("h/H8", "h/H0", 8) in up and not any(a == "h/H9" and b == "h/H0" for a, b, _ in up)  # eight edges and no ninth
    wanted = spark.createDataFrame([("method", o.encode(), m.encode(), b"()V") for o, m in (("h/H6", "mid"), ("h/H3", "top"), ("h/K", "both"), ("h/H3", "none"), ("h/Open", "x"), ("no/Where", "x"))],
                                   "kind string, owner binary, name binary, descriptor binary")
    got = {(r.owner.decode(), r.name.decode()): (r.state, name.get(r.declared_in)) for r in resolve.resolve_members(u, roots, wanted).collect()}
    assert got == {("h/H6", "mid"): ("resolved", "h/H4"), ("h/H3", "top"): ("resolved", "h/H0"), ("h/K", "both"): ("ambiguous", name[min(k for k, v in name.items() if v in ("h/I", "h/J"))]),
                   ("h/H3", "none"): ("missing", None), ("h/Open", "x"): ("incomplete", None), ("no/Where", "x"): ("missing", None)}
    refs = {(r.owner.decode(), r.state) for r in resolve.declaration_references(u, roots, "method", b"mid", b"()V").collect()}
    assert refs == {("h/H6", "resolved"), ("no/Where", "missing")}
    key = next(k for k, v in name.items() if v == "h/H1")
    below = {name[r.def_key] for r in resolve.dispatch_candidates(u, roots, key, b"mid", b"()V").collect()}
    assert below == {"h/H4"}
    mine = next(k for k, v in name.items() if v == "h/Caller")
    named = {(r.owner, r.state, name.get(r.declared_in), r.code_length) for r in resolve.callees(u, roots, mine, 0).collect()}
    assert named == {(b"h/H6", "resolved", "h/H4", 1), (b"no/Where", "missing", None, None)}


def test_reflection(spark):
    a = A.Assembler("x/R")
    p = a.pool
    call = p.method("java/lang/Class", "forName", "(Ljava/lang/String;)Ljava/lang/Class;")
    a.method("known", "()V", b"\x12" + bytes([p.string("a.B")]) + b"\xb8" + u2(call) + b"\x57\xb1")
    a.method("open", "(Ljava/lang/String;)V", b"\x2b\xb8" + u2(call) + b"\x57\xb1")
    got = {(r.member_index, r.state, r.target, r.reason) for r in resolve.reflection_patterns(files(spark, r=a.build())).collect()}
    assert got == {(0, "pattern_inferred_target", b"a.B", "constant_operand"), (1, "unknown", None, "operand_not_constant")}


# -- methods --------------------------------------------------------------------------------------------------------
def code_of(body, handlers=(), descriptor="()V", flags=0x9, pool=None, name="m"):
    a = A.Assembler("m/M")
    if pool:
        body = pool(a.pool)
    a.method(name, descriptor, body, flags=flags, handlers=handlers)
    u = next(S.walk("m", a.build()))
    return u["instructions"], u["handlers"], {r["cp_index"]: r for r in u["pool"]}, descriptor.encode()


def test_loop_and_dominators():
    # i = 0; while (i < n) i++; return i
    code, handlers, constants, d = code_of(b"\x03\x3c" + b"\x1b\x1a\xa2\x00\x09" + b"\x84\x01\x01" + b"\xa7\xff\xf8" + b"\x1b\xac", descriptor="(I)I")
    blocks, edges = D.control_flow(code, handlers)
    assert [b for b, _ in blocks] == [0, 2, 7, 13]
    idom = D.dominators(0, edges)
    assert idom == {0: None, 2: 0, 7: 2, 13: 2} and D.loops(edges, idom) == [(7, 2)]
    assert D.components(edges, [0, 2, 7, 13]) == {0: 0, 2: 2, 7: 2, 13: 13}
    assert D.phis(code, handlers, [0]) == {(2, 1): {0: "def@1", 7: "def@7"}}
    f = D.frames(code, handlers, constants, d, True, False)
    assert f[13].local == {0: "I", 1: "I"} and f[13].stack == []
    assert R.recover(code, handlers, constants, d, True)["text"] == "var v1 = 0;\nwhile (!(v1 >= p0)) {\n    v1 += 1;\n}\nreturn v1;\n"


def test_frames_merge_and_refuse():
    # two ways with different types in local 1: unusable after the join
    code, handlers, constants, d = code_of(b"\x1a\x99\x00\x08" + b"\x03\x3c\xa7\x00\x05" + b"\x0b\x44" + b"\xb1", descriptor="(I)V")
    assert 1 not in D.frames(code, handlers, constants, d, True, False)[11].local
    wide = b"\x0a\x0a\x5e\x58\x58\x58\xb1"  # dup2_x2 of two longs
    code, handlers, constants, d = code_of(wide)
    assert list(D.frames(code, handlers, constants, d, True, False)) == [0]
    for body, reason in ((b"\x57\xb1", "stack_underflow"), (b"\x0a\x57\xb1", "split_wide_value"), (b"\x03\xb0", "stack_type"), (b"\xa8\x00\x03\xb1", "subroutine"), (b"\x03", "falls_off_the_end"),
                         (b"\xa7\x00\x01\xb1", "invalid_branch_target")):
        code, handlers, constants, d = code_of(body)
        with pytest.raises(D.Refused, match=reason):
            D.frames(code, handlers, constants, d, True, False)
    # a handler sees every frame of its range; blocks may come in any order
    code, handlers, constants, d = code_of(b"\x03\x3b\x04\x3b\xb1\x57\xb1", handlers=((0, 4, 5, 0),))
    assert D.frames(code, handlers, constants, d, True, False)[5].stack == ["A"]


def test_new_objects_and_text():
    def body(p):
        return b"\xbb" + u2(p.cls("a/B")) + b"\x59" + b"\x12" + bytes([p.string('q"\n')]) + b"\xb7" + u2(p.method("a/B", "<init>", "(Ljava/lang/String;)V")) + b"\x4c" + b"\x2b\x1a\x05\x68\x60\xb0"

    code, handlers, constants, d = code_of(lambda: None, descriptor="(I)Ljava/lang/Object;", pool=lambda p: body(p)[:-5] + b"\x2b\xb0")
    assert "U@0" not in " ".join(str(f.local) for f in D.frames(code, handlers, constants, d, True, False).values())
    got = R.recover(code, handlers, constants, d, True)
    assert got["text"] == 'var v1 = new a.B("q\\"\\n");\nreturn v1;\n'
    assert [got["text"][s["start"] : s["end"]] for s in got["segments"]] == got["text"].splitlines()
    calls = lambda p: b"\xb8" + u2(p.method("a/B", "f", "()I")) + b"\xb3" + u2(p.field("a/B", "g", "I")) + b"\xb1"
    code, handlers, constants, d = code_of(None, pool=calls)
    assert R.recover(code, handlers, constants, d, True)["text"] == "a.B.g = a.B.f();\n"


def text_of(body, descriptor="()V", **more):
    code, handlers, constants, d = code_of(body, descriptor=descriptor, **more)
    got = R.recover(code, handlers, constants, d, True)
    return got["text"] if got["representation"] == "java" else got["reason"]


def test_regions():
    # if (p0 < 0) p0 = -p0; return p0
    assert text_of(b"\x1a\x9c\x00\x06\x1a\x74\x3b\x1a\xac", "(I)I") == "if (!(p0 >= 0)) {\n    p0 = (-p0);\n}\nreturn p0;\n"
    # if (flag) p1 = 1 else p1 = 2
    assert text_of(b"\x1a\x99\x00\x08\x04\x3c\xa7\x00\x05\x05\x3c\x1b\xac", "(ZI)I") == "if (p0) {\n    p1 = 1;\n} else {\n    p1 = 2;\n}\nreturn p1;\n"
    # two early returns, as booleans
    assert text_of(b"\x1a\x99\x00\x05\x04\xac\x03\xac", "(Z)Z") == "if (p0) {\n    return true;\n}\nreturn false;\n"
    # do { p0--; } while (p0 > 0)
    assert text_of(b"\x84\x00\xff\x1a\x9d\xff\xfc\xb1", "(I)V") == "do {\n    p0 += -1;\n} while ((p0 > 0));\n"
    # a nested loop and a condition in it
    body = b"\x1a\x9e\x00\x13" + b"\x1b\x9e\x00\x09" + b"\x84\x01\xff" + b"\xa7\xff\xf9" + b"\x84\x00\xff" + b"\xa7\xff\xef" + b"\xb1"
    assert text_of(body, "(II)V") == "while (!(p0 <= 0)) {\n    while (!(p1 <= 0)) {\n        p1 += -1;\n    }\n    p0 += -1;\n}\n"
    # NaN: if (a < b) compiles to fcmpg, ifge; the text must not run the branch for NaN
    assert text_of(b"\x22\x23\x96\x9c\x00\x05\x04\xac\x03\xac", "(FF)Z") == "if ((p0 < p1)) {\n    return true;\n}\nreturn false;\n"
    assert text_of(b"\x22\x23\x95\x9c\x00\x05\x04\xac\x03\xac", "(FF)Z") == "if (!(p0 >= p1)) {\n    return true;\n}\nreturn false;\n"
    assert text_of(b"\xaa\0\0\0" + struct.pack(">iiii", 20, 0, 0, 20) + b"\xb1" * 3) in ("switch", "stack_underflow")
    # the old value of a local is still on the stack when it is written
    assert text_of(b"\x1a\x05\x3b\xac", "(I)I") == "evaluation_order"
    # a value that crosses blocks (a conditional expression), and a local that outlives its scope
    assert text_of(b"\x1a\x99\x00\x07\x04\xa7\x00\x04\x05\xac", "(Z)I") == "value_across_blocks"
    assert text_of(b"\x1a\x99\x00\x05\x04\x3c\x1b\xac", "(Z)I") == "local_scope"


def test_analysis_and_export(spark, units, tmp_path):
    rows = methods.analyze(units).collect()
    bodies = S.members(units).where("has_code").count()
    assert len(rows) == bodies and {r.state for r in rows} == {"complete"}
    cheap = methods.analyze(units, ("raw_facts", "raw_cfg")).where("size(frames) > 0 or size(phis) > 0").count()
    assert cheap == 0  # what isn't asked for isn't made
    with pytest.raises(InvalidInput, match="stage_prerequisite"):
        methods.analyze(units, ("ssa",))
    text = methods.recover(units)
    for plane, values in methods.PLANES.items():
        assert {r[0] for r in text.select(plane).distinct().collect()} <= set(values)
    assert methods.source_map(text, bci=3).where("covered = 'return (p0 + p1);'").count() > 0
    sources = [r.source for r in methods.class_source(units, text).collect()]
    source = next(x for x in sources if x.startswith("public class p1.C3 implements java.lang.Runnable {\n    public int count;\n"))
    assert "    public int add(int p0, int p1) {\n        return (p0 + p1);\n    }\n" in source and source.index("<init>") < source.index("add(II)I")
    assert "    public C3() {\n        super();\n    }\n" in source and any(x.startswith("public class p2.C5 extends p2.C6 {\n") for x in sources)
    files_ = artifacts.sample_files(spark, 3)
    assert sorted(map(str, export.events(units).collect())) == sorted(map(str, export.events_of_files(files_).collect()))
    only = S.decoded(files_, wanted=("xrefs",))
    assert sorted(map(str, S.xrefs(only).collect())) == sorted(map(str, S.xrefs(units).collect())) and S.pool(only).count() == 0
    folder = f"file://{tmp_path}/out"
    told = export.export(units, folder).first()
    assert (told["bodies_declared"], told["bodies_delivered"], told["classes_discovered"]) == (bodies, bodies, told["classes_delivered"])
    lines = [json.loads(line) for f in sorted(glob.glob(f"{tmp_path}/out/1-events/part-*")) for line in open(f)]
    order = [(x["path"], x["unit_seq"], x["step"], x["member_index"]) for x in lines]
    assert order == sorted(order)
    with pytest.raises(Exception, match="(?i)exist"):
        export.export(units, folder)


def test_plugins(spark, units):
    bad = plugins.Rule("bad", 1, "classes", "result_items", "builtin", lambda u: u.select("no_such_column"))
    late = plugins.Rule("late", 1, "classes", "result_items", "builtin", lambda u: u.select("path", F.lit("x").alias("subject"), F.raise_error(F.lit("at run time")).cast("string").alias("detail")))
    found, states = plugins.run(units, ["services", "bad", "late", "what", "entry-points"], plugins.PLUGINS | {"bad": bad, "late": late})
    assert states == {"services": "completed", "entry-points": "completed", "bad": "stopped", "late": "stopped", "what": "unknown", "signatures": "not_requested",
                      "process-calls": "not_requested"}
    assert {(r.rule, r.subject, r.detail) for r in found.collect()} >= {("services", "service:p0.C0", "p0.C1"), ("entry-points", "entry:Main-Class", "p1.C0")}


def test_registry(spark):
    assert (registry.release(45), registry.release(71), registry.release(72), registry.release(44)) == ("registered", "registered", "unregistered_future_release", "unknown_release")
    rows = spark.createDataFrame([(n.encode(), k, m) for n, k, m in (("Record", "class", 59), ("Record", "class", 60), ("NestMembers", "method", 55), ("Mine", "class", 55), ("Module", "class", 52))],
                                 "name binary, owner_kind string, major int")
    got = {(r.name.decode(), r.major): r.placement for r in registry.placement(rows, spark).collect()}
    assert got == {("Record", 59): "version_not_applicable", ("Record", 60): "legal", ("NestMembers", 55): "location_not_applicable", ("Mine", 55): "not_registered", ("Module", 52): "version_not_applicable"}
    assert registry.reference_widens("java/math/BigDecimal", "java/lang/Number") and not registry.reference_widens("my/Type", "my/Above")


@pytest.mark.parametrize("name", sorted(artifacts.QUERIES))
def test_same_as_sql(spark, name):
    """What the queries find in the archives is what the rule put there."""
    got = duckdb.sql(artifacts.SQL[name])
    df = artifacts.QUERIES[name](spark, "")
    assert sorted(df.columns) == sorted(got.columns)
    want = sorted(tuple(map(str, r)) for r in got.fetchall())
    have = sorted(tuple(str(r[c]) for c in got.columns) for r in df.collect())
    assert have == want and have


def test_cli(spark, tmp_path, capsys):
    from factlane import cli

    (tmp_path / "s.jar").write_bytes(artifacts.sample_archive(0, 4))
    run = lambda *a: cli.run(spark, cli.parser().parse_args([*a]), sys.stdout)
    path = str(tmp_path / "s.jar")
    assert run("list-classes", path, "--format", "json") == 0 and '"name":"p0/C1.class"' in capsys.readouterr().out
    assert run("references", path, "--class", "p0.C1", "--name", "<init>", "--descriptor", "()V", "--max-items", "1") == 0
    assert "invocation" in capsys.readouterr().out
    assert run("recover", path, "--class", "p0.C1") == 0 and "return (p0 + p1);" in capsys.readouterr().out
    assert run("recover", path, "--class", "no.Such") == 3 and run("class-source", path, "--class", "p0.C0") == 3
    with pytest.raises(InvalidInput):
        run("list-classes", path, "--budget", "nope=1")


def test_chain_of_ten_classes(spark):
    u = files(spark, c=A.archive([(f"c/K{i}.class", cls(f"c/K{i}", f"c/K{i - 1}" if i else None, methods_=("far",) if i in (0, 9) else ())) for i in range(10)]))
    roots = resolve.environment(u, "plain_jar")
    name = {r.def_key: r.this_class.decode() for r in S.classes(u).collect()}
    top = next(k for k, v in name.items() if v == "c/K0")
    below = {name[r.def_key]: r.depth for r in resolve.dispatch_candidates(u, roots, top, b"far", b"()V").collect()}
    assert below == {"c/K9": 9}
    other = files(spark, d=A.archive([(f"d/K{i}.class", cls(f"d/K{i}", f"d/K{i - 1}" if i else None, methods_=() if i else ("far",))) for i in range(10)]))
    wanted = spark.createDataFrame([("method", b"d/K9", b"far", b"()V")], "kind string, owner binary, name binary, descriptor binary")
    assert [r.state for r in resolve.resolve_members(other, resolve.environment(other, "plain_jar"), wanted).collect()] == ["resolved"]


def test_interfaces_above_and_beside_each_other(spark):
    """Maximally specific methods: one below the other, unrelated defaults, an abstract one beside a default, abstract ones alone."""
    def interface(name, above=(), flags=0x1, code=b"\xb1"):
        a = A.Assembler(name, "i/Object", above, flags=0x601)
        if flags is not None:
            a.method("m", "()V", code, flags=flags)
        return a.build()

    named = {"i/Object": cls("i/Object", None), "i/I": interface("i/I"), "i/J": interface("i/J", ("i/I",)), "i/L": interface("i/L"), "i/K": interface("i/K", ("i/L",), None),
             "i/Abs": interface("i/Abs", (), 0x401, None), "i/Abs2": interface("i/Abs2", (), 0x401, None), "i/Stat": interface("i/Stat", (), 0x9),
             "i/A": cls("i/A", "i/Object", ("i/I", "i/J")), "i/B": cls("i/B", "i/Object", ("i/I", "i/K")), "i/C": cls("i/C", "i/Object", ("i/I", "i/Abs")),
             "i/D": cls("i/D", "i/Object", ("i/Abs", "i/Abs2")), "i/E": cls("i/E", "i/Object", ("i/Abs", "i/Stat")), "i/F": cls("i/F", "i/B", methods_=("m",)), "i/G": cls("i/G", "i/F")}
    u = files(spark, j=A.archive([(f"{n}.class", data) for n, data in named.items()]))
    roots = resolve.environment(u, "plain_jar")
    name = {r.def_key: r.this_class.decode() for r in S.classes(u).collect()}
    owners = "ABCDEFG"
    wanted = spark.createDataFrame([("method", f"i/{o}".encode(), b"m", b"()V") for o in owners], "kind string, owner binary, name binary, descriptor binary")
    got = {r.owner.decode(): (r.state, name[r.declared_in]) for r in resolve.resolve_members(u, roots, wanted).collect()}
    assert {o: got[f"i/{o}"] for o in "ACEFG"} == {"A": ("resolved", "i/J"), "C": ("resolved", "i/I"), "E": ("resolved", "i/Abs"), "F": ("resolved", "i/F"), "G": ("resolved", "i/F")}
    assert got["i/B"][0] == got["i/D"][0] == "ambiguous"


def test_fields_and_access(spark):
    def fielded(name, above, flags, interfaces=(), kind=0x21):
        a = A.Assembler(name, above, interfaces, flags=kind)
        if flags is not None:
            a.field("f", "I", flags)
        return a.build()

    named = {"p/Object": cls("p/Object", None), "p/I": fielded("p/I", "p/Object", 0x19, (), 0x601), "p/Base": fielded("p/Base", "p/Object", 0x4), "p/Sub": fielded("p/Sub", "p/Base", None),
             "p/Both": fielded("p/Both", "p/Base", None, ("p/I",)), "p/Deep": fielded("p/Deep", "p/Both", None), "p/Priv": fielded("p/Priv", "p/Object", 0x2), "p/Pack": fielded("p/Pack", "p/Object", 0x0),
             "q/Sub": fielded("q/Sub", "p/Base", None), "q/Far": cls("q/Far", "p/Object")}
    u = files(spark, j=A.archive([(f"{n}.class", data) for n, data in named.items()]))
    roots = resolve.environment(u, "plain_jar")
    name = {r.def_key: r.this_class.decode() for r in S.classes(u).collect()}
    cases = [("p/Sub", "p/Pack", "resolved", "p/Base"), ("p/Deep", "q/Far", "resolved", "p/I"), ("p/Sub", "q/Far", "inaccessible", "p/Base"), ("p/Sub", "q/Sub", "resolved", "p/Base"),
             ("p/Priv", "p/Priv$1", "resolved", "p/Priv"), ("p/Priv", "p/Pack", "inaccessible", "p/Priv"), ("p/Pack", "p/Priv", "resolved", "p/Pack"), ("p/Pack", "q/Far", "inaccessible", "p/Pack")]
    wanted = spark.createDataFrame([("field", o.encode(), b"f", b"I", c.encode()) for o, c, _, _ in cases], "kind string, owner binary, name binary, descriptor binary, caller binary")
    got = {(r.owner.decode(), r.caller.decode(), r.state, name[r.declared_in]) for r in resolve.resolve_members(u, roots, wanted).collect()}
    assert got == set(cases)
