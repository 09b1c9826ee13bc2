"""Artifacts as tables: class files and (nested) archives, read once into units, of which every fact table is a view.

``units`` decodes files of Spark's binaryFile reader, so inputs may be in any store that Spark reads.  A unit is one entry
of an archive, or a file that is a class by itself; its members, constants, instructions and references are nested
columns, so a query that needs one of them reads only that part of the stored table.  Identity is physical: a container
is the chain of ordinals that leads to it, an entry its ordinal in the container; names are never identity, and equal
bytes at two places are two rows.

Damage never drops rows: an unreadable entry has a read_status and a code, a damaged class keeps what could be read, an
archive that cannot be listed gives the entries that its local headers still tell and a row with the range that was
skipped, and a container below ``depth`` is a row with the code of the limit.

Reading is bounded: each file is one operation with a budget of its own, which every entry, inflated byte, class, attribute
and body is charged to before the work.  Where a charge is refused the walk ends: what came before is the result, and the
last row is the one that was stopped, with the dimension and the numbers.  Entries that aren't wanted are listed, unread.
"""

from __future__ import annotations

import hashlib
import io
import struct as binary
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import classfile as C
from ..functions import modern
from ..functions.references import References
from ..functions.schema import struct
from ..plans.request import Budget, BudgetExceeded, Limits

MEMBER = "kind string, index int, flags int, name binary, descriptor binary, has_code boolean, code_start bigint, code_length bigint, max_stack int, max_locals int, signature_agrees boolean"
POOL = "cp_index int, tag string, owner binary, name binary, descriptor binary, lit_kind string, lit_bits bigint, lit_utf binary"
INSTRUCTION = "member_index int, bci int, opcode int, width int, cp_index int, local int, value int, targets array<int>, keys array<int>"
HANDLER = "member_index int, start int, end int, target int, type binary"
ATTRIBUTE = "owner_kind string, owner_index int, name binary, start bigint, length bigint"
XREF = ("consumer string, target_kind string, owner binary, name binary, descriptor binary, member_index int, bci int, cp_index int, lit_kind string, lit_bits bigint, lit_utf binary, "
        "via string, opcode int, relation string, derivation string, certainty string, resolution string")
MODERN = "fact string, name binary, value binary"
RESOURCE = "rule string, key string, value string"
UNIT = """snapshot_id string, path string, unit_seq bigint, container_id string, depth int, ordinal bigint, raw_name binary, name string, method string, is_dir boolean, size bigint, crc bigint,
is_class_candidate boolean, read_status string, stop_code string, def_key string, digest string, length bigint, variant_version int, major int, minor int, flags int,
this_class binary, super_class binary, interfaces array<binary>, class_state string, class_code string, name_binding string, problems array<string>"""
SCHEMA = struct(UNIT, members=MEMBER, pool=POOL, instructions=INSTRUCTION, handlers=HANDLER, attributes=ATTRIBUTE, xrefs=XREF, resources=RESOURCE, modern=MODERN)
METHODS = {zipfile.ZIP_STORED: "stored", zipfile.ZIP_DEFLATED: "deflated"}
ARCHIVES = (b"PK\x03\x04", b"PK\x05\x06")
DEPTH = 4
VERSIONS = "META-INF/versions/"


def _manifest(text: str) -> Iterator[tuple[str, str]]:
    """The main section's attributes, continuation lines joined."""
    lines: list[str] = []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if line.startswith(" ") and lines:
            lines[-1] += line[1:]
        elif not line:
            break
        else:
            lines.append(line)
    for line in lines:
        key, mark, value = line.partition(": ")
        if mark:
            yield key, value


#: The manifest attributes that name classes, paths or runtime behaviour.
MANIFEST_KEYS = ("Main-Class", "Launcher-Agent-Class", "Premain-Class", "Agent-Class", "Class-Path", "Automatic-Module-Name", "Multi-Release")


def resources(name: str, data: bytes) -> list[dict]:
    """What standard resources say: manifest attributes, service files, signature files (never verified here)."""
    out = []
    if name.upper() == "META-INF/MANIFEST.MF":
        for key, value in _manifest(data.decode("utf-8", "replace")):
            if key in MANIFEST_KEYS:
                values = value.split() if key == "Class-Path" else [value.strip()]
                out += [{"rule": "manifest", "key": key, "value": v} for v in values]
    elif name.startswith("META-INF/services/") and not name.endswith("/"):
        for line in data.decode("utf-8", "replace").splitlines():
            if provider := line.partition("#")[0].strip():
                out.append({"rule": "service", "key": name[len("META-INF/services/") :], "value": provider})
    elif name.upper().startswith("META-INF/") and name.upper().rpartition(".")[2] in ("SF", "RSA", "DSA", "EC"):
        out.append({"rule": "signature", "key": name, "value": "not_verified"})
    return out


def _pool(f: C.ClassFile) -> list[dict]:
    out = []
    for index, (tag, *rest) in f.pool.items():
        row = dict.fromkeys(("owner", "name", "descriptor", "lit_kind", "lit_bits", "lit_utf")) | {"cp_index": index, "tag": C.TAG_NAMES[tag]}
        try:
            if tag == C.UTF8:
                row["lit_utf"] = rest[0]
            elif tag in (C.CLASS, C.MODULE, C.PACKAGE):
                row["owner"] = f.utf8(rest[0])
            elif tag in (C.FIELDREF, C.METHODREF, C.INTERFACE_METHODREF):
                _, row["owner"], row["name"], row["descriptor"] = f.reference(index)
            elif tag == C.NAME_AND_TYPE:
                row["name"], row["descriptor"] = f.pair(index)
            elif tag in C.LITERALS:
                row["lit_kind"], row["lit_bits"], row["lit_utf"] = f.literal(index)
            elif tag == C.METHOD_TYPE:
                row["descriptor"] = f.utf8(rest[0])
            elif tag in (C.DYNAMIC, C.INVOKE_DYNAMIC):
                row["name"], row["descriptor"] = f.pair(rest[1])
        except C.Damaged:
            row["tag"] += "_damaged"
        out.append(row)
    return out


#: Nested facts of a class; what isn't asked for isn't built.
FACTS = ("members", "pool", "instructions", "handlers", "attributes", "xrefs", "modern")


@dataclass
class Reading:
    """How one file is read, and what that has used so far."""

    depth: int = DEPTH
    wanted: tuple[str, ...] | None = FACTS  # None: names alone
    names: frozenset[bytes] | None = None  # entries to be read; None: all
    budget: Budget = field(default_factory=Budget)
    stopped: bool = False

    def reads(self, raw: bytes) -> bool:
        return self.wanted is not None and (self.names is None or raw in self.names)

    def stop(self, unit: dict, e: BudgetExceeded) -> dict:
        """The row at which the walk ends."""
        self.stopped = True
        return unit | {"read_status": "stopped", "stop_code": "budget_exceeded", "problems": [f"{e.dimension}: {e.consumed} + {e.requested} > {e.limit}"]}


def _class(unit: dict, data: bytes, wanted: tuple[str, ...], budget: Budget) -> None:
    budget.charge("class_bytes", len(data))
    budget.charge("class_headers", 1)
    f = C.decode(data)
    budget.charge("attribute_bytes", sum(a.length for a in f.attributes) + sum(a.length for m in f.members for a in m.attributes))
    members, instructions, handlers, attributes = [], [], [], []
    attributes += [{"owner_kind": "class", "owner_index": -1, "name": a.name, "start": a.start, "length": a.length} for a in f.attributes]
    for k, m in enumerate(f.members if {"members", "instructions", "handlers", "attributes"} & {*wanted} else ()):
        for a in f.find(m.attributes, b"Code") if m.kind == "method" else ():
            budget.charge("method_bodies", 1)
            budget.charge("code_bytes", int.from_bytes(data[a.start + 4 : a.start + 8]))
        body = C.code(f, m) if m.kind == "method" else None
        agrees = None
        for a in f.find(m.attributes, b"Signature"):
            try:
                agrees = C.erasure_matches(f.utf8(f.body(a).u2()), m.descriptor)
            except C.Damaged:
                agrees = False
        members.append({"kind": m.kind, "index": k, "flags": m.flags, "name": m.name, "descriptor": m.descriptor, "has_code": body is not None,
                        "code_start": body and body.start, "code_length": body and body.length, "max_stack": body and body.max_stack,
                        "max_locals": body and body.max_locals, "signature_agrees": agrees})
        attributes += [{"owner_kind": m.kind, "owner_index": k, "name": a.name, "start": a.start, "length": a.length} for a in m.attributes]
        if body is not None:
            instructions += [{"member_index": k, "bci": i.bci, "opcode": i.opcode, "width": i.width, "cp_index": i.cp, "local": i.local, "value": i.value,
                              "targets": list(i.targets), "keys": list(i.keys)} for i in body.instructions]
            handlers += [{"member_index": k, "start": h.start, "end": h.end, "target": h.target, "type": h.type} for h in body.handlers]
    refs = References(f)
    xrefs = list(refs.rows()) if "xrefs" in wanted else []
    plain = unit["name"].removesuffix(".class")
    if plain.startswith(VERSIONS):
        plain = plain[len(VERSIONS):].partition("/")[2]
    binding = "standalone_root" if unit["container_id"] is None else "path_name_agrees" if plain.encode() == f.this else "path_name_differs"
    unit |= {"major": f.major, "minor": f.minor, "flags": f.flags, "this_class": f.this or None, "super_class": f.super, "interfaces": f.interfaces,
             "class_state": f.state, "class_code": f.code, "name_binding": binding if f.this else "unconfirmed", "members": members, "pool": _pool(f) if "pool" in wanted else [],
             "instructions": instructions if "instructions" in wanted else [], "handlers": handlers, "attributes": attributes if "attributes" in wanted else [],
             "xrefs": xrefs, "modern": modern.facts(f) if "modern" in wanted else [], "problems": refs.problems}


def _variant(name: str) -> int | None:
    if name.startswith(VERSIONS):
        level = name[len(VERSIONS):].partition("/")[0]
        return int(level) if level.isdigit() else None
    return None


def _blank(snapshot: str, path: str, container: str | None, depth: int, ordinal: int, raw: bytes) -> dict:
    name = C.display(raw)
    return dict.fromkeys(SCHEMA.names) | {"snapshot_id": snapshot, "path": path, "container_id": container, "depth": depth, "ordinal": ordinal, "raw_name": raw, "name": name,
                                          "is_dir": False, "is_class_candidate": raw.endswith(b".class"), "read_status": "read", "interfaces": [], "members": [], "pool": [],
                                          "instructions": [], "handlers": [], "attributes": [], "xrefs": [], "resources": [], "modern": [], "problems": []}


def _content(unit: dict, data: bytes, reading: Reading) -> None:
    digest = hashlib.sha256(data).hexdigest()
    unit |= {"digest": digest, "length": len(data)}
    if unit["is_class_candidate"]:
        key = f"{unit['snapshot_id']}|{unit['container_id']}|{unit['ordinal']}|{digest}|{unit['variant_version']}"
        unit["def_key"] = hashlib.sha256(key.encode()).hexdigest()
        _class(unit, data, reading.wanted or (), reading.budget)
    else:
        unit["resources"] = resources(unit["name"], data)


def walk(path: str, data: bytes, depth: int = DEPTH, wanted: tuple[str, ...] | None = FACTS, names: frozenset[bytes] | None = None, limits: Limits | None = None,
         budget: Budget | None = None) -> Iterator[dict]:
    """The units of one file, numbered in physical order: archives entry by entry, descending into archives in them.

    wanted: the nested facts to build, None for a listing that reads no class; names: the entries to read, the others are
    listed; limits: of the file's budget, or a budget that shares a ledger.  Units come one at a time: who stops asking stops
    the reading, and a cancelled budget ends it with a row that says so.
    """
    limits = budget.limits if budget is not None else limits or Limits()
    most = depth if limits.nested_depth is None else min(depth, limits.nested_depth)
    reading, seq = Reading(most, wanted, names, budget if budget is not None else Budget(limits)), -1
    try:
        for seq, unit in enumerate(_walk(path, data, reading)):
            yield unit | {"unit_seq": seq}
    except InterruptedError:
        yield _blank("", path, None, 0, -1, b"") | {"unit_seq": seq + 1, "read_status": "stopped", "stop_code": "cancelled"}


def _walk(path: str, data: bytes, reading: Reading) -> Iterator[dict]:
    try:
        reading.budget.charge("input_bytes", len(data))
    except BudgetExceeded as e:
        yield reading.stop(_blank("", path, None, 0, 0, b"") | {"method": "root", "size": len(data)}, e)
        return
    snapshot = hashlib.sha256(data).hexdigest()
    if data[:4] in ARCHIVES:
        yield from _archive(snapshot, path, data, snapshot, 0, reading)
        return
    unit = _blank(snapshot, path, None, 0, 0, b"") | {"is_class_candidate": data[:4] == b"\xca\xfe\xba\xbe", "method": "root", "size": len(data)}
    try:
        _content(unit, data, reading)
    except BudgetExceeded as e:
        unit = reading.stop(unit, e)
    if not unit["is_class_candidate"]:
        unit |= {"read_status": "unsupported", "stop_code": "unknown_root"}
    yield unit


def _archive(snapshot: str, path: str, data: bytes, container: str, depth: int, reading: Reading) -> Iterator[dict]:
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        infos = z.infolist()
    except (zipfile.BadZipFile, ValueError, EOFError, NotImplementedError) as e:
        z, infos, damage = None, _Local(data), type(e).__name__
    for ordinal, info in enumerate(infos):
        raw = info.orig_filename.encode("utf-8" if info.flag_bits & 0x800 else "cp437", "replace")
        unit = _blank(snapshot, path, container, depth, ordinal, raw) | {
            "method": METHODS.get(info.compress_type, f"method_{info.compress_type}"), "is_dir": raw.endswith(b"/"), "size": info.file_size, "crc": info.CRC,
            "variant_version": _variant(C.display(raw))}
        inner = b""
        try:
            reading.budget.charge("archive_entries", 1)
            if info.flag_bits & 1:
                unit |= {"read_status": "unsupported", "stop_code": "encrypted"}
            elif info.compress_type not in METHODS:
                unit |= {"read_status": "unsupported", "stop_code": "unknown_method"}
            elif not unit["is_dir"]:
                opened = (lambda info=info: z.open(info)) if z else info.open
                body = _inflated(unit, opened, info, raw, reading)
                inner = body if body[:4] in ARCHIVES else b""
        except BudgetExceeded as e:
            yield reading.stop(unit, e)
            return
        except InterruptedError:  # cancelled; an OSError by class alone
            raise
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, OSError) as e:
            unit |= {"read_status": "damaged", "stop_code": "crc_mismatch" if "CRC" in str(e) else "entry_unreadable"}
        if inner and depth + 1 > reading.depth:
            unit |= {"read_status": "partial", "stop_code": "nested_depth"}
            inner = b""
        yield unit
        if inner:
            below = hashlib.sha256(f"{container}|{ordinal}|{unit['digest']}".encode()).hexdigest()
            yield from _archive(snapshot, path, inner, below, depth + 1, reading)
            if reading.stopped:
                return
    if z is None:
        yield _blank(snapshot, path, container, depth, -1, b"") | {"read_status": "damaged", "stop_code": "directory_unreadable",
                                                                  "problems": [damage, f"skipped: {infos.at}-{len(data)}"]}


def _inflated(unit: dict, opened, info, raw: bytes, reading: Reading) -> bytes:
    """The entry's bytes, read into the unit where they are wanted; what is only listed is read if it is an archive itself."""
    if not reading.reads(raw):
        unit["read_status"] = "listed"
        with opened() as f:
            if f.read(4) not in ARCHIVES:
                return b""
    reading.budget.charge("entry_bytes", info.file_size)  # nothing inflates beyond the size that its header tells
    with opened() as f:
        body = f.read()
    if reading.reads(raw):
        reading.budget.charge("read_bytes", len(body))
        _content(unit, body, reading)
    else:
        unit |= {"digest": hashlib.sha256(body).hexdigest(), "length": len(body)}
    return body


class _Local:
    """The entries that an archive's local headers tell, from its start to the first that is cut short or hides its size."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def __iter__(self) -> Iterator[_LocalEntry]:
        while self.data[self.at : self.at + 4] == ARCHIVES[0] and len(self.data) >= self.at + 30:
            flags, method, crc, packed, size, n, extra = binary.unpack("<2xHH4xIIIHH", self.data[self.at + 4 : self.at + 30])
            start = self.at + 30 + n + extra
            if flags & 9 or start + packed > len(self.data):
                return
            name = self.data[self.at + 30 : self.at + 30 + n].decode("utf-8" if flags & 0x800 else "cp437", "replace")
            yield _LocalEntry(name, flags, method, crc, size, self.data[start : start + packed])
            self.at = start + packed


@dataclass
class _LocalEntry:
    orig_filename: str
    flag_bits: int
    compress_type: int
    CRC: int
    file_size: int
    packed: bytes

    def open(self) -> io.BytesIO:
        body = self.packed if self.compress_type == zipfile.ZIP_STORED else zlib.decompressobj(-15).decompress(self.packed, self.file_size + 1)
        if len(body) != self.file_size or zlib.crc32(body) != self.CRC:
            raise zipfile.BadZipFile("CRC or size")
        return io.BytesIO(body)


def _batches(rows: Iterator[dict], size: int = 64) -> Iterator[pa.RecordBatch]:
    schema, held = to_arrow_schema(SCHEMA), []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def decoded(files: DataFrame, depth: int = DEPTH, wanted: tuple[str, ...] | None = FACTS, names: frozenset[bytes] | None = None, limits: Limits | None = None) -> DataFrame:
    """The units of files given as (path, content), with the nested facts that are wanted (see ``walk``)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(batch.column("path"), batch.column("content"), strict=True):
                yield from _batches(walk(p.as_py(), data.as_py(), depth, wanted, names, limits))

    return files.select("path", "content").mapInArrow(decode, SCHEMA)


def units(spark: SparkSession, path: str, depth: int = DEPTH, limits: Limits | None = None) -> DataFrame:
    """The units of all files at path (a file, a folder or a pattern).  Store the result before querying it repeatedly."""
    return decoded(spark.read.format("binaryFile").load(path), depth, limits=limits)


def listed(files: DataFrame, depth: int = DEPTH, limits: Limits | None = None) -> DataFrame:
    """The units by name alone: no class is read, no entry inflated but archives in archives."""
    return decoded(files, depth, None, limits=limits)


def directed(files: DataFrame, names: list[bytes], depth: int = DEPTH, wanted: tuple[str, ...] = FACTS, limits: Limits | None = None) -> DataFrame:
    """The units of the entries of these names, in every container; no other class is read."""
    return decoded(files, depth, wanted, frozenset(names), limits).where(F.col("read_status") != "listed")


_PLACE = ["snapshot_id", "path", "unit_seq", "container_id", "ordinal", "def_key"]


def _exploded(u: DataFrame, column: str) -> DataFrame:
    """One row for each item of a nested column, with its place in it (seq)."""
    return u.select(*_PLACE, "this_class", F.posexplode(column).alias("seq", "x")).select(*_PLACE, "this_class", "seq", "x.*")


def snapshots(u: DataFrame) -> DataFrame:
    return u.groupBy("snapshot_id", "path").agg(F.count(F.lit(1)).alias("units"), F.max("depth").alias("nested_depth"),
                                                F.min(F.when(F.col("method") == "root", "class").otherwise("archive")).alias("kind"))


def containers(u: DataFrame) -> DataFrame:
    """Containers with whether their directory could be listed."""
    return u.where("container_id is not null").groupBy("snapshot_id", "container_id", "depth").agg(
        F.count(F.when(F.col("ordinal") >= 0, 1)).alias("entries"), (F.count(F.when(F.col("stop_code").isin("directory_unreadable", "budget_exceeded"), 1)) == 0).alias("directory_complete"))


def entries(u: DataFrame) -> DataFrame:
    return u.where("container_id is not null and ordinal >= 0").select(
        "snapshot_id", "path", "container_id", "depth", "ordinal", "raw_name", "name", "method", "is_dir", "size", "crc", "is_class_candidate", "read_status", "stop_code", "variant_version")


def classes(u: DataFrame) -> DataFrame:
    return u.where("is_class_candidate and def_key is not null").select(
        *_PLACE, "name", "digest", "length", "variant_version", "major", "minor", "flags", "this_class", "super_class", "interfaces", "class_state", "class_code", "name_binding")


def members(u: DataFrame) -> DataFrame:
    return _exploded(u, "members")


def pool(u: DataFrame) -> DataFrame:
    return _exploded(u, "pool")


def instructions(u: DataFrame) -> DataFrame:
    return _exploded(u, "instructions")


def handlers(u: DataFrame) -> DataFrame:
    return _exploded(u, "handlers")


def attributes(u: DataFrame) -> DataFrame:
    return _exploded(u, "attributes")


def xrefs(u: DataFrame) -> DataFrame:
    return _exploded(u, "xrefs")


def modern_facts(u: DataFrame) -> DataFrame:
    return _exploded(u, "modern")


def resource_rows(u: DataFrame) -> DataFrame:
    return _exploded(u, "resources").drop("this_class")


def unit_status(u: DataFrame) -> DataFrame:
    """One row a unit: complete, partial (with the first code) or damaged; feeds coverage."""
    code = F.coalesce("stop_code", "class_code", F.try_element_at("problems", F.lit(1)))
    state = F.when(F.col("read_status") != "read", F.col("read_status")).when(code.isNotNull(), F.coalesce(F.nullif("class_state", F.lit("complete")), F.lit("partial"))).otherwise("complete")
    return u.select("snapshot_id", "path", "container_id", "depth", "ordinal", "name", "is_class_candidate", state.alias("state"), code.alias("code"))


def multi_release(u: DataFrame, release: int) -> DataFrame:
    """Per container and plain name the entry that a runtime of this release selects; versions need the manifest's word."""
    says = (resource_rows(u).where("rule = 'manifest' and key = 'Multi-Release' and lower(value) = 'true'").select("snapshot_id", "container_id").distinct().withColumn("multi", F.lit(True)))
    plain = F.when(F.col("variant_version").isNotNull(), F.regexp_replace("name", r"^META-INF/versions/[0-9]+/", "")).otherwise(F.col("name"))
    told = entries(u).where("not is_dir").join(says, ["snapshot_id", "container_id"], "left").withColumn("plain_name", plain)
    fits = F.col("variant_version").isNull() | (F.coalesce("multi", F.lit(False)) & (F.col("variant_version") <= release) & (F.col("variant_version") >= 9))
    level = F.coalesce("variant_version", F.lit(0))
    best = told.where(fits).groupBy("snapshot_id", "container_id", "plain_name").agg(F.max(level).alias("best"))
    return (told.join(best, ["snapshot_id", "container_id", "plain_name"], "left").withColumn("selected", fits & (level == F.col("best")))
            .select("snapshot_id", "container_id", "plain_name", "ordinal", "variant_version", F.coalesce("selected", F.lit(False)).alias("selected")))


def runtime_matrix(u: DataFrame, releases: list[int]) -> DataFrame:
    """The same scan under several releases, each row under its own."""
    out = None
    for r in sorted(set(releases)):
        part = multi_release(u, r).withColumn("release", F.lit(r))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no release")
    return out


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        import pyarrow.fs as pfs

        files, path = pfs.FileSystem.from_uri(self.options["path"]) if "://" in self.options["path"] else (pfs.LocalFileSystem(), self.options["path"])
        info = files.get_file_info(path)
        found = [info] if info.type == pfs.FileType.File else files.get_file_info(pfs.FileSelector(path, recursive=True))
        return [_File(x.path) for x in sorted(found, key=lambda x: x.path) if x.type == pfs.FileType.File]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pfs

        files = pfs.FileSystem.from_uri(self.options["path"])[0] if "://" in self.options["path"] else pfs.LocalFileSystem()
        with files.open_input_file(partition.path) as f:
            yield from _batches(walk(partition.path, f.read(), int(self.options.get("depth", DEPTH))))


class ArtifactSource(DataSource):
    """spark.read.format("artifact").load(path), once registered with spark.dataSource.register(ArtifactSource)."""

    @classmethod
    def name(cls) -> str:
        return "artifact"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def root_bytes(spark: SparkSession, path: str, budget) -> bytes:
    """The bytes of one file; its length is charged (read and output) before a byte of it is read."""
    files = spark.read.format("binaryFile").load(path)
    told = files.select("path", "length").limit(2).collect()  # column pruning: no content is read for this
    if len(told) != 1:
        raise ValueError("one file is needed")
    for dimension in ("read_bytes", "output_bytes"):
        budget.charge(dimension, told[0]["length"])
    return bytes(files.select("content").first()["content"])
