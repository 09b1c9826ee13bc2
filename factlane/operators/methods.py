"""Method analysis over units: control flow, frames, SSA and text, one class at a time and every method of it.

Each stage is only computed where it is asked for.  A method that cannot be analysed is a row with a state and a code;
it never fails its class, and the order of rows and of blocks is that of the class file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import classfile as C
from ..functions import dataflow as D
from ..functions import recover as R
from ..functions.schema import struct
from ..plans.request import InvalidInput
from ..sources import artifact as S

#: Stages in order, each with the stages that it needs.
STAGES = {"raw_facts": (), "raw_cfg": ("raw_facts",), "canonical_cfg": ("raw_cfg",), "frames": ("canonical_cfg",), "ssa": ("frames",)}
#: The planes of a recovered method and the values each can take.
PLANES = {"representation": ("java", "listing"), "quality": ("recovered", "fallback"), "syntax": ("not_checked",), "compile": ("not_attempted",),
          "semantic_validation": ("not_attempted",), "verification": ("not_performed",)}
BLOCKS_MOST = 65_535
STATIC = 0x0008
PLACE = "path string, unit_seq bigint, def_key string, this_class binary, member_index int, name binary, descriptor binary"
ANALYSIS = struct(PLACE + ", state string, code string, started array<string>, done array<string>", blocks="start int, end int, idom int, component int",
                  edges="source int, target int, kind string", back_edges="source int, target int",
                  frames="block int, stack string, locals string", phis="block int, local int, source int, value string")
RECOVERED = struct(PLACE + ", representation string, quality string, syntax string, compile string, semantic_validation string, verification string, reason string, text string, artifact string",
                   segments="start int, end int, bci int")


def check_stages(stages: tuple[str, ...]) -> tuple[str, ...]:
    """Known stages, each after what it needs; the order is the table's."""
    for s in stages:
        if s not in STAGES:
            raise InvalidInput("unknown_stage")
        if any(n not in stages for n in STAGES[s]):
            raise InvalidInput("stage_prerequisite")
    return tuple(s for s in STAGES if s in stages)


def _methods(unit: dict) -> Iterator[tuple[dict, list[dict], list[dict], dict[int, dict]]]:
    constants = {r["cp_index"]: r for r in unit["pool"]}
    code: dict[int, list[dict]] = {}
    for i in unit["instructions"]:
        code.setdefault(i["member_index"], []).append(i)
    handlers: dict[int, list[dict]] = {}
    for h in unit["handlers"]:
        handlers.setdefault(h["member_index"], []).append(h)
    for m in unit["members"]:
        if m["has_code"]:
            yield m, code.get(m["index"], []), handlers.get(m["index"], []), constants


def _place(unit: dict, m: dict) -> dict:
    return {"path": unit["path"], "unit_seq": unit["unit_seq"], "def_key": unit["def_key"], "this_class": unit["this_class"], "member_index": m["index"],
            "name": m["name"], "descriptor": m["descriptor"]}


def _analysed(m: dict, code: list[dict], handlers: list[dict], constants: dict[int, dict], stages: tuple[str, ...]) -> dict:
    out: dict = {"state": "complete", "code": None, "started": ["raw_facts"], "done": ["raw_facts"], "blocks": [], "edges": [], "back_edges": [], "frames": [], "phis": []}
    try:
        if "raw_cfg" not in stages or not code:
            return out
        out["started"].append("raw_cfg")
        blocks, edges = D.control_flow(code, handlers)
        if len(blocks) > BLOCKS_MOST:
            raise D.Refused("too_many_blocks")
        starts = [b for b, _ in blocks]
        idom, group = D.dominators(starts[0], edges), D.components(edges, starts)
        out["edges"] = [{"source": a, "target": b, "kind": k} for a, b, k in edges]
        out["blocks"] = [{"start": a, "end": b, "idom": idom.get(a), "component": group[a]} for a, b in blocks]
        out["done"].append("raw_cfg")
        if "canonical_cfg" in stages:
            out["started"].append("canonical_cfg")
            if any(k in ("jsr", "ret") for _, _, k in edges):
                raise D.Refused("subroutine")
            out["back_edges"] = [{"source": a, "target": b} for a, b in D.loops(edges, idom)]
            out["done"].append("canonical_cfg")
        static = bool(m["flags"] & STATIC)
        if "frames" in stages:
            out["started"].append("frames")
            found = D.frames(code, handlers, constants, m["descriptor"], static, m["name"] == b"<init>")
            out["frames"] = [{"block": b, "stack": " ".join(f.stack), "locals": " ".join(f"{k}:{t}" for k, t in sorted(f.local.items()))} for b, f in sorted(found.items())]
            out["done"].append("frames")
        if "ssa" in stages:
            out["started"].append("ssa")
            given, n = ([] if static else [0]), 0 if static else 1
            for a in C.arguments(m["descriptor"])[0]:
                given.append(n)
                n += 2 if a in (b"J", b"D") else 1
            out["phis"] = [{"block": b, "local": k, "source": p, "value": v} for (b, k), ways in sorted(D.phis(code, handlers, given).items()) for p, v in ways.items()]
            out["done"].append("ssa")
    except (D.Refused, C.Damaged) as e:
        out |= {"state": "refused", "code": e.code}
    return out


def _each(each: Callable[[dict, dict, list[dict], list[dict], dict[int, dict]], dict], schema) -> Callable:
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.to_pylist():
                rows = [_place(unit, m) | each(unit, m, code, handlers, constants) for m, code, handlers, constants in _methods(unit)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return run


_NEEDED = ["path", "unit_seq", "def_key", "this_class", "members", "pool", "instructions", "handlers"]


def analyze(u: DataFrame, stages: tuple[str, ...] = tuple(STAGES)) -> DataFrame:
    """One row a method body: blocks with dominators and components, edges, back edges, entry frames and phis."""
    wanted = check_stages(stages)
    rows = u.where("def_key is not null").select(*_NEEDED)
    return rows.mapInArrow(_each(lambda unit, m, code, handlers, constants: _analysed(m, code, handlers, constants, wanted), ANALYSIS), ANALYSIS)


def observations(analysis: DataFrame) -> DataFrame:
    """How often each stage was started and completed, over all bodies."""
    rows = analysis.select(F.explode("started").alias("stage"), F.col("done"))
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("starts"), F.count(F.when(F.expr("array_contains(done, stage)"), 1)).alias("completions"))


#: The kinds of evidence that a recovery can carry; what isn't asked for isn't built.
EVIDENCE = ("source_map", "region_details", "rule_details", "name_details", "read_details")


def _text(unit: dict, m: dict, code: list[dict], handlers: list[dict], constants: dict[int, dict]) -> dict:
    got = R.recover(code, handlers, constants, m["descriptor"], bool(m["flags"] & STATIC), unit["this_class"])
    kind = got["representation"]
    return {"representation": kind, "quality": "recovered" if kind == "java" else "fallback", "syntax": "not_checked", "compile": "not_attempted",
            "semantic_validation": "not_attempted", "verification": "not_performed", "reason": got["reason"], "text": got["text"], "artifact": None, "segments": got["segments"]}


_BODY = ["members", "pool", "instructions", "handlers"]


def _texts_schema(keep: tuple[str, ...]) -> T.StructType:
    inner = T.StructType([T.StructField("member_index", T.IntegerType()), T.StructField("name", T.BinaryType()), T.StructField("descriptor", T.BinaryType()),
                          *[f for f in RECOVERED.fields if f.name in ("representation", "quality", "reason", "text", "segments")]])
    return T.StructType([*[S.SCHEMA[c] for c in keep], T.StructField("declared_members", T.IntegerType()), T.StructField("declared_bodies", T.IntegerType()),
                         T.StructField("texts", T.ArrayType(inner))])


def _with_texts(units: Iterator[dict], keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    arrow, rows = to_arrow_schema(_texts_schema(keep)), []
    for unit in units:
        texts = [{"member_index": m["index"], "name": m["name"], "descriptor": m["descriptor"]} | _text(unit, m, code, handlers, constants)
                 for m, code, handlers, constants in _methods(unit)]
        rows.append({k: unit[k] for k in keep} | {"declared_members": len(unit["members"]), "declared_bodies": len(texts), "texts": texts})
        if len(rows) >= 256:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=arrow)


def with_texts(u: DataFrame, *keep: str) -> DataFrame:
    """The units' columns in ``keep``, the numbers of members and bodies, and the bodies' texts as a nested column: one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _with_texts((unit for batch in batches for unit in batch.to_pylist()), keep)

    return u.select(*dict.fromkeys([*keep, "this_class", *_BODY])).mapInArrow(run, _texts_schema(keep))


def texts_of_files(files: DataFrame, *keep: str, depth: int = S.DEPTH) -> DataFrame:
    """As ``with_texts``, straight from (path, content): facts never leave the task that decodes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(batch.column("path"), batch.column("content"), strict=True):
                yield from _with_texts(S.walk(p.as_py(), data.as_py(), depth, tuple(_BODY)), keep)

    return files.select("path", "content").mapInArrow(run, _texts_schema(keep))


def _evidence(unit: dict, m: dict, code: list[dict], handlers: list[dict], constants: dict[int, dict], wanted: tuple[str, ...]) -> dict:
    """Details of one recovery by kind; only the wanted kinds are worked out."""
    out = {}
    try:
        if "region_details" in wanted:
            blocks, edges = D.control_flow(code, handlers)
            out["region_details"] = [f"{a}-{b}" for a, b in blocks] + [f"{a}>{b}:{k}" for a, b, k in edges]
        if "name_details" in wanted:
            out["name_details"] = [f"local {k}" for k in sorted({i["local"] for i in code if i["local"] is not None and i["local"] >= 0})]
    except (D.Refused, C.Damaged) as e:
        out["region_details"] = [f"refused: {e.code}"]
    if "rule_details" in wanted:
        out["rule_details"] = ["constructor"] if m["name"] == b"<init>" else []
    if "read_details" in wanted:
        out["read_details"] = [f"instructions {len(code)}", f"constants {len({i['cp_index'] for i in code if i['cp_index'] is not None and i['cp_index'] > 0})}"]
    return out


def recover(u: DataFrame, evidence: tuple[str, ...] = ("source_map",)) -> DataFrame:
    """One row a method body: its text, the planes that say what it is worth, and the evidence that is asked for.

    artifact identifies the inputs that the text depends on; segments is the source map, details the other kinds.
    """
    for kind in evidence:
        if kind not in EVIDENCE:
            raise InvalidInput("unknown_evidence")
    more = tuple(k for k in evidence if k != "source_map")

    def each(unit, m, code, handlers, constants):
        out = _text(unit, m, code, handlers, constants)
        kept = out if "source_map" in evidence else out | {"segments": []}
        return kept | ({"details": list(_evidence(unit, m, code, handlers, constants, more).items())} if more else {})

    schema = T.StructType([*RECOVERED.fields, T.StructField("details", T.MapType(T.StringType(), T.ArrayType(T.StringType())))]) if more else RECOVERED
    rows = u.where("def_key is not null").select(*_NEEDED).mapInArrow(_each(each, schema), schema)
    return rows.withColumn("artifact", F.sha2(F.concat_ws("|", F.lit("recover-1"), "def_key", F.hex("name"), F.hex("descriptor")), 256))


def source_map(recovered: DataFrame, at: int | None = None, bci: int | None = None) -> DataFrame:
    """Which text came from an instruction, or which instruction a character came from."""
    rows = recovered.select("def_key", "member_index", "text", F.explode("segments").alias("s"))
    if at is not None:
        rows = rows.where((F.col("s.start") <= at) & (F.col("s.end") > at))
    if bci is not None:
        rows = rows.where(F.col("s.bci") == bci)
    return rows.select("def_key", "member_index", "s.start", "s.end", "s.bci", F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("covered"))


#: Access flags in the order in which modifiers are written, with what each means on a class, field and method.
MODIFIERS = [(0x0001, "public", "public", "public"), (0x0002, "private", "private", "private"), (0x0004, "protected", "protected", "protected"), (0x0400, "abstract", "", "abstract"),
             (0x0008, "static", "static", "static"), (0x0010, "final", "final", "final"), (0x0080, "", "transient", ""), (0x0040, "", "volatile", ""),
             (0x0020, "", "", "synchronized"), (0x0100, "", "", "native"), (0x0800, "", "", "strictfp")]
SOURCE = "path string, unit_seq bigint, def_key string, source string"


def _modifiers(flags: int, what: int) -> str:
    return "".join(f"{m[what]} " for m in MODIFIERS if flags & m[0] and m[what])


def _declaration(c: dict) -> str:
    """The class's line, with its kind, superclass and interfaces."""
    flags, name = c["flags"] or 0, R.class_name(c["this_class"])
    interface = bool(flags & 0x0200)
    kind = "@interface" if flags & 0x2000 else "interface" if interface else "enum" if flags & 0x4000 else "class"
    line = _modifiers(flags & ~0x0400 if interface else flags, 1) + f"{kind} {name}"
    if not interface and c["super_class"] not in (None, b"java/lang/Object", b"java/lang/Enum"):
        line += f" extends {R.class_name(c['super_class'])}"
    above = [R.class_name(i) for i in c["interfaces"] or [] if not (flags & 0x2000 and i == b"java/lang/annotation/Annotation")]
    return line + (f" {'extends' if interface else 'implements'} {', '.join(above)}" if above else "") + " {\n"


def _member(c: dict, m: dict, text: str | None) -> str:
    flags, name = m["flags"], C.display(m["name"])
    try:
        if m["kind"] == "field":
            return f"    {_modifiers(flags, 2)}{R.type_name(m['descriptor'])} {name};\n"
        given, back = C.arguments(m["descriptor"])
    except C.Damaged as e:
        return f"    // {name}: {e.code}\n"
    if m["name"] == b"<clinit>":
        line = "static"
    else:
        called = R.class_name(c["this_class"]).rpartition(".")[2] if m["name"] == b"<init>" else f"{R.type_name(back)} {name}"
        line = f"{_modifiers(flags, 3)}{called}({', '.join(f'{R.type_name(a)} p{k}' for k, a in enumerate(given))})"
    head = f"    // {name}{C.display(m['descriptor'])}\n    {line}"
    if text is None:
        return head + ";\n"
    return head + " {\n" + "".join(f"        {x}\n" for x in text.splitlines()) + "    }\n"


def class_source(u: DataFrame, recovered: DataFrame) -> DataFrame:
    """One row a class: its declaration, fields and methods in the order of the class file, each method under its name and descriptor."""
    texts = recovered.groupBy("def_key").agg(F.collect_list(F.struct("member_index", "text")).alias("texts"))
    rows = u.where("def_key is not null and this_class is not null").select("path", "unit_seq", "def_key", "this_class", "super_class", "interfaces", "flags", "members").join(texts, "def_key", "left")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c in batch.to_pylist():
                text = {t["member_index"]: t["text"] for t in c["texts"] or []}
                body = "".join(_member(c, m, text.get(m["index"])) for m in c["members"])
                out.append({k: c[k] for k in ("path", "unit_seq", "def_key")} | {"source": _declaration(c) + body + "}\n"})
            yield pa.RecordBatch.from_pylist(out, schema=to_arrow_schema(struct(SOURCE)))

    return rows.mapInArrow(assemble, SOURCE)
