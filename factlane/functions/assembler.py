"""Writes small class files and archives: inputs for tests and for the artifact queries."""

from __future__ import annotations

import io
import struct
import warnings
import zipfile

from . import classfile as C


class Pool:
    def __init__(self) -> None:
        self.items: list[bytes] = []
        self.at: dict[tuple, int] = {}
        self.next = 1

    def put(self, tag: int, *values) -> int:
        key = (tag, *values)
        if key not in self.at:
            if tag == C.UTF8:
                self.items.append(struct.pack(">BH", tag, len(values[0])) + values[0])
            else:
                self.items.append(struct.pack(">B", tag) + struct.pack(C.LAYOUT[tag], *values))
            self.at[key] = self.next
            self.next += 2 if tag in (C.LONG, C.DOUBLE) else 1
        return self.at[key]

    def utf8(self, text: str | bytes) -> int:
        return self.put(C.UTF8, text.encode() if isinstance(text, str) else text)

    def cls(self, name: str) -> int:
        return self.put(C.CLASS, self.utf8(name))

    def string(self, text: str) -> int:
        return self.put(C.STRING, self.utf8(text))

    def pair(self, name: str, descriptor: str) -> int:
        return self.put(C.NAME_AND_TYPE, self.utf8(name), self.utf8(descriptor))

    def ref(self, tag: int, owner: str, name: str, descriptor: str) -> int:
        return self.put(tag, self.cls(owner), self.pair(name, descriptor))

    def method(self, owner: str, name: str, descriptor: str) -> int:
        return self.ref(C.METHODREF, owner, name, descriptor)

    def field(self, owner: str, name: str, descriptor: str) -> int:
        return self.ref(C.FIELDREF, owner, name, descriptor)


class Assembler:
    """Builds one class: give methods their code as bytes made with ``pool``'s indexes."""

    def __init__(self, name: str, above: str | None = "java/lang/Object", interfaces: tuple[str, ...] = (), major: int = 52, flags: int = 0x21):
        self.pool, self.major, self.flags = Pool(), major, flags
        self.this, self.above = self.pool.cls(name), self.pool.cls(above) if above else 0
        self.interfaces = [self.pool.cls(i) for i in interfaces]
        self.members: dict[str, list[bytes]] = {"field": [], "method": []}
        self.attributes: list[bytes] = []

    def attribute(self, name: str, body: bytes) -> bytes:
        return struct.pack(">HI", self.pool.utf8(name), len(body)) + body

    def _member(self, kind: str, flags: int, name: str, descriptor: str, attributes: list[bytes]) -> None:
        self.members[kind].append(struct.pack(">HHHH", flags, self.pool.utf8(name), self.pool.utf8(descriptor), len(attributes)) + b"".join(attributes))

    def field(self, name: str, descriptor: str, flags: int = 0x1, attributes: tuple[bytes, ...] = ()) -> None:
        self._member("field", flags, name, descriptor, list(attributes))

    def method(self, name: str, descriptor: str, code: bytes | None = None, flags: int = 0x1, handlers: tuple[tuple[int, int, int, int], ...] = (),
               stack: int = 8, local: int = 8, attributes: tuple[bytes, ...] = (), inside: tuple[bytes, ...] = ()) -> None:
        out = list(attributes)
        if code is not None:
            table = struct.pack(">H", len(handlers)) + b"".join(struct.pack(">HHHH", *h) for h in handlers)
            out.append(self.attribute("Code", struct.pack(">HHI", stack, local, len(code)) + code + table + struct.pack(">H", len(inside)) + b"".join(inside)))
        self._member("method", flags, name, descriptor, out)

    def build(self) -> bytes:
        tail = struct.pack(">HHHH", self.flags, self.this, self.above, len(self.interfaces)) + b"".join(struct.pack(">H", i) for i in self.interfaces)
        for kind in ("field", "method"):
            tail += struct.pack(">H", len(self.members[kind])) + b"".join(self.members[kind])
        tail += struct.pack(">H", len(self.attributes)) + b"".join(self.attributes)
        return struct.pack(">IHHH", C.MAGIC, 0, self.major, self.pool.next) + b"".join(self.pool.items) + tail


def archive(entries: list[tuple[str, bytes]], stored: bool = False) -> bytes:
    """A ZIP with the entries in order, the same whenever it is written; repeated names stay."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                z.writestr(info, data)
    return out.getvalue()


def sample_class(package: str, k: int, above: str = "java/lang/Object") -> bytes:
    """A class that makes an object, calls a neighbour, reads a field, loads literals and branches."""
    a = Assembler(f"{package}/C{k}", above, ("java/lang/Runnable",) if k % 3 == 0 else ())
    p = a.pool
    other = f"{package}/C{k + 1}"
    a.field("count", "I")
    a.method("<init>", "()V", b"\x2a" + b"\xb7" + struct.pack(">H", p.method(above, "<init>", "()V")) + b"\xb1")
    a.method("add", "(II)I", b"\x1b\x1c\x60\xac")
    a.method("call", "()V", b"\xbb" + struct.pack(">H", p.cls(other)) + b"\x59" + b"\xb7" + struct.pack(">H", p.method(other, "<init>", "()V")) + b"\x4c"
             + b"\x2a\xb4" + struct.pack(">H", p.field(f"{package}/C{k}", "count", "I")) + b"\x9a\x00\x09" + b"\x12" + bytes([p.string(f"text {k}")]) + b"\x57\xa7\x00\x03" + b"\xb1")
    a.method("run", "()V", b"\x2a\xb6" + struct.pack(">H", p.method(f"{package}/C{k}", "call", "()V")) + b"\xb1")
    p.method("never/Used", "atAll", "()V")
    return a.build()
