"""A class file decoder after the JVM specification (chapter 4): bytes in, plain facts out.

Nothing is resolved or executed.  A file that ends early or has an unknown tag keeps what was read before, with a state
and a code; names keep their raw (modified UTF-8) bytes, which are their identity.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

MAGIC = 0xCAFEBABE
#: Constant pool tags and the layouts of their items.
UTF8, INTEGER, FLOAT, LONG, DOUBLE, CLASS, STRING, FIELDREF, METHODREF, INTERFACE_METHODREF, NAME_AND_TYPE = 1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12
METHOD_HANDLE, METHOD_TYPE, DYNAMIC, INVOKE_DYNAMIC, MODULE, PACKAGE = 15, 16, 17, 18, 19, 20
LAYOUT = {INTEGER: ">i", FLOAT: ">I", LONG: ">q", DOUBLE: ">Q", CLASS: ">H", STRING: ">H", FIELDREF: ">HH", METHODREF: ">HH", INTERFACE_METHODREF: ">HH",
          NAME_AND_TYPE: ">HH", METHOD_HANDLE: ">BH", METHOD_TYPE: ">H", DYNAMIC: ">HH", INVOKE_DYNAMIC: ">HH", MODULE: ">H", PACKAGE: ">H"}
TAG_NAMES = {UTF8: "utf8", INTEGER: "integer", FLOAT: "float", LONG: "long", DOUBLE: "double", CLASS: "class", STRING: "string", FIELDREF: "fieldref",
             METHODREF: "methodref", INTERFACE_METHODREF: "interface_methodref", NAME_AND_TYPE: "name_and_type", METHOD_HANDLE: "method_handle",
             METHOD_TYPE: "method_type", DYNAMIC: "dynamic", INVOKE_DYNAMIC: "invoke_dynamic", MODULE: "module", PACKAGE: "package"}
LITERALS = {INTEGER: "int", FLOAT: "float", LONG: "long", DOUBLE: "double", STRING: "string"}


class Damaged(Exception):
    """The bytes don't hold what their structure says; ``code`` names why."""

    def __init__(self, code: str, at: int):
        super().__init__(f"{code} at {at}")
        self.code, self.at = code, at


_STRUCTS: dict[str, struct.Struct] = {}


class Cursor:
    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise Damaged("truncated", self.at)
        self.at += n
        return self.data[self.at - n : self.at]

    def get(self, layout: str):
        one = _STRUCTS.get(layout) or _STRUCTS.setdefault(layout, struct.Struct(layout))
        at = self.at
        if at + one.size > self.end:
            raise Damaged("truncated", at)
        self.at = at + one.size
        values = one.unpack_from(self.data, at)
        return values[0] if len(values) == 1 else values

    def u1(self) -> int:
        at = self.at
        if at >= self.end:
            raise Damaged("truncated", at)
        self.at = at + 1
        return self.data[at]

    def u2(self) -> int:
        at = self.at
        if at + 2 > self.end:
            raise Damaged("truncated", at)
        self.at = at + 2
        return self.data[at] << 8 | self.data[at + 1]

    def u4(self) -> int:
        return self.get(">I")


@dataclass
class Attribute:
    name: bytes
    start: int
    length: int


@dataclass
class Member:
    kind: str
    index: int
    flags: int
    name: bytes
    descriptor: bytes
    attributes: list[Attribute]


@dataclass
class ClassFile:
    data: bytes
    minor: int = 0
    major: int = 0
    pool: dict[int, tuple] = field(default_factory=dict)  # index -> (tag, values...)
    flags: int = 0
    this: bytes = b""
    super: bytes | None = None
    interfaces: list[bytes] = field(default_factory=list)
    members: list[Member] = field(default_factory=list)
    attributes: list[Attribute] = field(default_factory=list)
    state: str = "complete"
    code: str | None = None

    # -- constants
    def constant(self, index: int, *tags: int) -> tuple:
        item = self.pool.get(index)
        if item is None or (tags and item[0] not in tags):
            raise Damaged("constant_pool_index", index)
        return item

    def utf8(self, index: int) -> bytes:
        return self.constant(index, UTF8)[1]

    def class_name(self, index: int) -> bytes:
        return self.utf8(self.constant(index, CLASS, MODULE, PACKAGE)[1])

    def pair(self, index: int) -> tuple[bytes, bytes]:
        _, name, descriptor = self.constant(index, NAME_AND_TYPE)
        return self.utf8(name), self.utf8(descriptor)

    def reference(self, index: int) -> tuple[str, bytes, bytes, bytes]:
        """(kind, owner, name, descriptor) of a field or method reference."""
        tag, owner, pair = self.constant(index, FIELDREF, METHODREF, INTERFACE_METHODREF)
        return "field" if tag == FIELDREF else "method", self.class_name(owner), *self.pair(pair)

    def literal(self, index: int) -> tuple[str, int | None, bytes | None] | None:
        """(kind, bits, bytes) of a loadable literal; floating point by its bits."""
        tag, *rest = self.constant(index)
        if tag not in LITERALS:
            return None
        if tag == STRING:
            return "string", None, self.utf8(rest[0])
        bits = rest[0]
        if tag == DOUBLE and bits >= 1 << 63:
            bits -= 1 << 64
        return LITERALS[tag], bits, None

    def body(self, attribute: Attribute) -> Cursor:
        return Cursor(self.data, attribute.start, attribute.start + attribute.length)

    def find(self, attributes: list[Attribute], name: bytes) -> list[Attribute]:
        return [a for a in attributes if a.name == name]


def decode(data: bytes, strict: bool = False) -> ClassFile:
    """Header, pool, members and attribute shells; bodies stay bytes until they are asked for.

    Reading is forensic: damage ends it with what could be read.  A strict one raises instead, as it does for names and
    flags that no valid class has.
    """
    out = ClassFile(data)
    c = Cursor(data)
    try:
        if c.u4() != MAGIC:
            raise Damaged("bad_magic", 0)
        out.minor, out.major = c.u2(), c.u2()
        n = c.u2()
        index = 1
        while index < n:
            tag = c.u1()
            if tag == UTF8:
                out.pool[index] = (UTF8, c.take(c.u2()))
            elif tag in LAYOUT:
                values = c.get(LAYOUT[tag])
                out.pool[index] = (tag, *(values if isinstance(values, tuple) else (values,)))
            else:
                raise Damaged("unknown_constant", c.at - 1)
            index += 2 if tag in (LONG, DOUBLE) else 1
        out.flags = c.u2()
        out.this = out.class_name(c.u2())
        above = c.u2()
        out.super = out.class_name(above) if above else None
        out.interfaces = [out.class_name(c.u2()) for _ in range(c.u2())]
        for kind in ("field", "method"):
            for k in range(c.u2()):
                flags, name, descriptor = c.get(">HHH")
                out.members.append(Member(kind, k, flags, out.utf8(name), out.utf8(descriptor), _shells(out, c)))
        out.attributes = _shells(out, c)
        if c.at != c.end:
            raise Damaged("trailing_bytes", c.at)
        if strict:
            _valid(out)
    except Damaged as e:
        if strict:
            raise
        out.state, out.code = ("damaged" if e.code == "bad_magic" else "partial"), e.code
    return out


def _valid(f: ClassFile) -> None:
    """What a strict reading asks beyond the layout: a name, a superclass (but for the root), flags that go together, members once."""
    interface = bool(f.flags & 0x0200)
    if not f.this:
        raise Damaged("no_name", 0)
    if f.super is None and f.this != b"java/lang/Object" and not f.flags & 0x8000:
        raise Damaged("no_superclass", 0)
    if (interface and (not f.flags & 0x0400 or f.flags & 0x0010)) or (f.flags & 0x0410 == 0x0410):
        raise Damaged("class_flags", 0)
    seen = set()
    for m in f.members:
        if bin(m.flags & 0x0007).count("1") > 1:
            raise Damaged("member_flags", 0)
        if (m.kind, m.name, m.descriptor) in seen:
            raise Damaged("member_twice", 0)
        seen.add((m.kind, m.name, m.descriptor))


def _shells(f: ClassFile, c: Cursor) -> list[Attribute]:
    out = []
    for _ in range(c.u2()):
        name, length = f.utf8(c.u2()), c.u4()
        out.append(Attribute(name, c.at, length))
        c.take(length)
    return out


# -- code -----------------------------------------------------------------------------------------------------------
@dataclass
class Instruction:
    bci: int
    opcode: int
    width: int
    cp: int | None = None
    local: int | None = None
    value: int | None = None
    targets: tuple[int, ...] = ()
    keys: tuple[int, ...] = ()


@dataclass
class Handler:
    start: int
    end: int
    target: int
    type: bytes | None


@dataclass
class Code:
    max_stack: int
    max_locals: int
    start: int
    length: int
    instructions: list[Instruction]
    handlers: list[Handler]
    attributes: list[Attribute]
    state: str = "complete"
    code: str | None = None


def _instruction(c: Cursor, base: int) -> Instruction:
    at = c.at
    bci, op = at - base, c.u1()
    ins = Instruction(bci, op, 0)
    if op == 16:
        ins.value = c.get(">b")
    elif op == 17:
        ins.value = c.get(">h")
    elif op == 18:
        ins.cp = c.u1()
    elif op in (19, 20) or 178 <= op <= 184 or op in (187, 189, 192, 193):
        ins.cp = c.u2()
    elif 21 <= op <= 25 or 54 <= op <= 58 or op == 169:
        ins.local = c.u1()
    elif 26 <= op <= 45:
        ins.local = (op - 26) % 4
    elif 59 <= op <= 78:
        ins.local = (op - 59) % 4
    elif op == 132:
        ins.local, ins.value = c.get(">Bb")
    elif 153 <= op <= 168 or op in (198, 199):
        ins.targets = (bci + c.get(">h"),)
    elif op in (200, 201):
        ins.targets = (bci + c.get(">i"),)
    elif op in (170, 171):
        c.take(-(c.at - base) % 4)
        default = c.get(">i")
        if op == 170:
            low, high = c.get(">ii")
            if high < low or high - low > (c.end - c.at) // 4:
                raise Damaged("bad_switch", at)
            ins.keys = tuple(range(low, high + 1))
            offsets = [c.get(">i") for _ in ins.keys]
        else:
            n = c.get(">i")
            if n < 0 or n > (c.end - c.at) // 8:
                raise Damaged("bad_switch", at)
            pairs = [c.get(">ii") for _ in range(n)]
            ins.keys, offsets = tuple(k for k, _ in pairs), [o for _, o in pairs]
        ins.targets = (bci + default, *(bci + o for o in offsets))
    elif op in (185, 186):
        ins.cp = c.u2()
        c.take(2)
    elif op == 188:
        ins.value = c.u1()
    elif op == 197:
        ins.cp, ins.value = c.get(">HB")
    elif op == 196:
        ins.value = c.u1()  # the widened opcode
        ins.local = c.u2()
        if ins.value == 132:
            c.take(2)
        elif not (21 <= ins.value <= 25 or 54 <= ins.value <= 58 or ins.value == 169):
            raise Damaged("bad_wide", at)
    elif op > 201:
        raise Damaged("unknown_opcode", at)
    ins.width = c.at - at
    return ins


def code(f: ClassFile, member: Member) -> Code | None:
    """The body of a method; decoding stops at the first bad instruction and keeps what came before."""
    shells = f.find(member.attributes, b"Code")
    if not shells:
        return None
    c = f.body(shells[0])
    try:
        stack, local, length = c.get(">HHI")
        out = Code(stack, local, c.at, length, [], [], [])
        inner = Cursor(f.data, c.at, c.at + length)
        c.take(length)
        try:
            while inner.at < inner.end:
                out.instructions.append(_instruction(inner, out.start))
        except Damaged as e:
            out.state, out.code = "partial", e.code
        for _ in range(c.u2()):
            start, end, target, kind = c.get(">HHHH")
            out.handlers.append(Handler(start, end, target, f.class_name(kind) if kind else None))
        out.attributes = _shells(f, c)
    except Damaged as e:
        return Code(0, 0, shells[0].start, 0, [], [], [], "partial", e.code)
    return out


# -- descriptors and signatures -------------------------------------------------------------------------------------
def descriptor_types(descriptor: bytes) -> list[bytes]:
    """The class names in a field or method descriptor, in order."""
    out, at = [], 0
    while (at := descriptor.find(b"L", at)) >= 0:
        end = descriptor.find(b";", at)
        if end < 0:
            break
        out.append(descriptor[at + 1 : end])
        at = end + 1
    return out


def arguments(descriptor: bytes) -> tuple[list[bytes], bytes]:
    """(parameter descriptors, return descriptor); raises Damaged for anything else than a method descriptor."""
    if descriptor[:1] != b"(":
        raise Damaged("bad_descriptor", 0)
    out, at = [], 1

    def one(at: int) -> int:
        start = at
        while descriptor[at : at + 1] == b"[":
            at += 1
        if descriptor[at : at + 1] == b"L":
            at = descriptor.find(b";", at)
            if at < 0:
                raise Damaged("bad_descriptor", start)
        elif descriptor[at : at + 1] not in [bytes([b]) for b in b"BCDFIJSZV"]:
            raise Damaged("bad_descriptor", at)
        return at + 1

    while descriptor[at : at + 1] != b")":
        end = one(at)
        out.append(descriptor[at:end])
        at = end
    end = one(at + 1)
    if end != len(descriptor):
        raise Damaged("bad_descriptor", end)
    return out, descriptor[at + 1 :]


def array_class(name: bytes) -> bytes | None:
    """The class behind a class constant: arrays name their element class, primitive arrays none."""
    if not name.startswith(b"["):
        return name
    inner = name.lstrip(b"[")
    return inner[1:-1] if inner.startswith(b"L") else None


class _Signature:
    """Generic signatures (4.7.9.1), erased while they are read."""

    def __init__(self, text: bytes):
        self.text, self.at, self.names, self.bounds = text, 0, [], {}

    def peek(self) -> bytes:
        return self.text[self.at : self.at + 1]

    def expect(self, mark: bytes) -> None:
        if self.peek() != mark:
            raise Damaged("bad_signature", self.at)
        self.at += 1

    def identifier(self) -> bytes:
        start = self.at
        while self.peek() and self.peek() not in b".;[/<>:":
            self.at += 1
        if start == self.at:
            raise Damaged("bad_signature", start)
        return self.text[start : self.at]

    def parameters(self) -> None:
        if self.peek() != b"<":
            return
        self.at += 1
        while self.peek() != b">":
            name = self.identifier()
            bound = None
            self.expect(b":")
            if self.peek() not in (b":", b">") and self.peek() in (b"L", b"T", b"["):
                bound = self.type()
            while self.peek() == b":":
                self.at += 1
                extra = self.type()
                bound = bound or extra
            self.bounds[name] = bound or b"Ljava/lang/Object;"
        self.at += 1

    def type(self) -> bytes:
        """The erasure of the type that begins here."""
        mark = self.peek()
        if mark == b"[":
            self.at += 1
            return b"[" + self.type()
        if mark == b"T":
            self.at += 1
            name = self.identifier()
            self.expect(b";")
            return self.bounds.get(name, b"Ljava/lang/Object;")
        if mark == b"L":
            self.at += 1
            parts = [self.identifier()]
            name = parts[0]
            while True:
                m = self.peek()
                if m == b"/":
                    self.at += 1
                    name += b"/" + self.identifier()
                elif m == b"<":
                    self.at += 1
                    while self.peek() != b">":
                        if self.peek() == b"*":
                            self.at += 1
                            continue
                        if self.peek() in (b"+", b"-"):
                            self.at += 1
                        self.type()
                    self.at += 1
                elif m == b".":
                    self.at += 1
                    name += b"$" + self.identifier()
                else:
                    self.expect(b";")
                    self.names.append(name)
                    return b"L" + name + b";"
        if mark and mark in b"BCDFIJSZV":
            self.at += 1
            return mark
        raise Damaged("bad_signature", self.at)


def signature_types(text: bytes) -> list[bytes]:
    """Every class that a class, method or field signature names."""
    s = _Signature(text)
    _whole(s)
    return s.names


def _whole(s: _Signature) -> bytes:
    s.parameters()
    if s.peek() == b"(":
        s.at += 1
        erased = b"("
        while s.peek() != b")":
            erased += s.type()
        s.at += 1
        erased += b")" + s.type()
        while s.peek() == b"^":
            s.at += 1
            s.type()
    else:
        erased = s.type()
        while s.at < len(s.text):
            s.type()  # a class's interfaces
    if s.at != len(s.text):
        raise Damaged("bad_signature", s.at)
    return erased


def erasure_matches(signature: bytes, descriptor: bytes) -> bool:
    """Whether a member's generic signature erases to its descriptor."""
    try:
        return _whole(_Signature(signature)) == descriptor
    except Damaged:
        return False


# -- annotations ----------------------------------------------------------------------------------------------------
def _element(f: ClassFile, c: Cursor) -> Iterator[bytes]:
    kind = bytes([c.u1()])
    if kind == b"e":
        yield from descriptor_types(f.utf8(c.u2()))
        c.u2()
    elif kind == b"c":
        yield from descriptor_types(f.utf8(c.u2()))
    elif kind == b"@":
        yield from _annotation(f, c)
    elif kind == b"[":
        for _ in range(c.u2()):
            yield from _element(f, c)
    elif kind in [bytes([b]) for b in b"BCDFIJSZs"]:
        c.u2()
    else:
        raise Damaged("bad_annotation", c.at)


def _annotation(f: ClassFile, c: Cursor) -> Iterator[bytes]:
    yield from descriptor_types(f.utf8(c.u2()))
    for _ in range(c.u2()):
        c.u2()
        yield from _element(f, c)


def _type_target(c: Cursor) -> None:
    kind = c.u1()
    if kind in (0x00, 0x01, 0x16):
        c.take(1)
    elif kind in (0x10, 0x11, 0x12, 0x17, 0x42, 0x43, 0x44, 0x45, 0x46):
        c.take(2)
    elif kind in (0x40, 0x41):
        c.take(6 * c.u2())
    elif 0x47 <= kind <= 0x4B:
        c.take(3)
    elif kind not in (0x13, 0x14, 0x15):
        raise Damaged("bad_annotation", c.at)
    c.take(2 * c.u1())


def annotation_types(f: ClassFile, attribute: Attribute) -> list[bytes]:
    """The classes that an annotation attribute names; its content must end where the attribute ends."""
    c, out = f.body(attribute), []
    name = attribute.name
    if name == b"AnnotationDefault":
        out += _element(f, c)
    elif name.endswith(b"ParameterAnnotations"):
        for _ in range(c.u1()):
            for _ in range(c.u2()):
                out += _annotation(f, c)
    else:
        for _ in range(c.u2()):
            if name.endswith(b"TypeAnnotations"):
                _type_target(c)
            out += _annotation(f, c)
    if c.at != c.end:
        raise Damaged("bad_annotation", c.at)
    return out


def bootstrap_methods(f: ClassFile) -> list[tuple[int, list[int]]]:
    """(handle, arguments) of each bootstrap method, as constant pool indexes."""
    shells = f.find(f.attributes, b"BootstrapMethods")
    if not shells:
        return []
    c = f.body(shells[0])
    return [(c.u2(), [c.u2() for _ in range(c.u2())]) for _ in range(c.u2())]


def display(raw: bytes) -> str:
    """Modified UTF-8 as text for people: what doesn't decode is escaped; never an identity."""
    return raw.replace(b"\xc0\x80", b"\\0").decode("utf-8", "backslashreplace")
