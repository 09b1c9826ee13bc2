"""Structural references of one class file: every consumed symbol, with where and how it is used.

Constants that no instruction or attribute uses are pool entries, not references.
"""

from __future__ import annotations

from collections.abc import Iterator

from . import classfile as C

ANNOTATIONS = (b"RuntimeVisibleAnnotations", b"RuntimeInvisibleAnnotations", b"RuntimeVisibleParameterAnnotations", b"RuntimeInvisibleParameterAnnotations",
               b"RuntimeVisibleTypeAnnotations", b"RuntimeInvisibleTypeAnnotations", b"AnnotationDefault")
CONSUMERS = ("invocation", "field", "type", "constant", "exception", "signature", "annotation", "inner_nest", "module", "bootstrap", "resource")


def _row(consumer: str, kind: str, owner: bytes | None = None, name: bytes | None = None, descriptor: bytes | None = None, *, member: int = -1, bci: int = -1,
         cp: int = -1, literal: tuple | None = None, via: str = "", opcode: int = -1) -> dict:
    lit = literal or (None, None, None)
    return {"consumer": consumer, "target_kind": kind, "owner": owner, "name": name, "descriptor": descriptor, "member_index": member, "bci": bci, "cp_index": cp,
            "lit_kind": lit[0], "lit_bits": lit[1], "lit_utf": lit[2], "via": via, "opcode": opcode, "relation": "mentions_symbol", "derivation": "structural",
            "certainty": "exact", "resolution": "not_resolved"}


def _types(consumer: str, names: list[bytes], via: str, **where) -> Iterator[dict]:
    for n in names:
        yield _row(consumer, "class", n, via=via, **where)


def _class_of(f: C.ClassFile, index: int) -> list[bytes]:
    name = C.array_class(f.class_name(index))
    return [name] if name else []


class References:
    """Reads one class; ``rows`` yields its references and keeps the codes of what it could not read."""

    def __init__(self, f: C.ClassFile):
        self.f, self.problems = f, []

    def safely(self, rows: Iterator[dict]) -> Iterator[dict]:
        try:
            yield from rows
        except C.Damaged as e:
            self.problems.append(e.code)

    def rows(self) -> Iterator[dict]:
        f = self.f
        if f.super:
            yield _row("type", "class", f.super, via="super")
        yield from _types("type", f.interfaces, "interface")
        yield from self.attributes(f.attributes, -1, "class")
        for k, m in enumerate(f.members):
            yield from self.attributes(m.attributes, k, m.kind)
            if m.kind == "method" and (body := C.code(f, m)) is not None:
                if body.state != "complete":
                    self.problems.append(body.code or "partial")
                yield from self.safely(self.body(body, k))

    def attributes(self, shells: list[C.Attribute], member: int, place: str) -> Iterator[dict]:
        for a in shells:
            yield from self.safely(self.attribute(a, member, place))

    def attribute(self, a: C.Attribute, member: int, place: str) -> Iterator[dict]:
        f, name = self.f, a.name
        if name == b"Signature":
            yield from _types("signature", C.signature_types(f.utf8(f.body(a).u2())), place, member=member)
        elif name in ANNOTATIONS:
            yield from _types("annotation", C.annotation_types(f, a), f"{place}:{name.decode()}", member=member)
        elif name == b"Exceptions":
            c = f.body(a)
            yield from _types("exception", [f.class_name(c.u2()) for _ in range(c.u2())], "throws", member=member)
        elif name == b"InnerClasses":
            c = f.body(a)
            for _ in range(c.u2()):
                inner, outer, _, _ = c.get(">HHHH")
                yield from _types("inner_nest", [f.class_name(i) for i in (inner, outer) if i], "InnerClasses")
        elif name in (b"NestHost", b"EnclosingMethod"):
            yield from _types("inner_nest", [f.class_name(f.body(a).u2())], name.decode())
        elif name in (b"NestMembers", b"PermittedSubclasses"):
            c = f.body(a)
            yield from _types("inner_nest", [f.class_name(c.u2()) for _ in range(c.u2())], name.decode())
        elif name == b"Record":
            c = f.body(a)
            for _ in range(c.u2()):
                c.u2()
                yield from _types("type", C.descriptor_types(f.utf8(c.u2())), "record_component")
                yield from self.attributes(C._shells(f, c), member, "record_component")
        elif name == b"Module":
            yield from self.module(f.body(a))

    def module(self, c: C.Cursor) -> Iterator[dict]:
        f = self.f
        c.take(6)
        for _ in range(c.u2()):
            yield _row("module", "module", f.class_name(c.u2()), via="requires")
            c.take(4)
        for what in ("exports", "opens"):
            for _ in range(c.u2()):
                yield _row("module", "package", f.class_name(c.u2()), via=what)
                c.take(2)
                for _ in range(c.u2()):
                    yield _row("module", "module", f.class_name(c.u2()), via=f"{what}_to")
        for _ in range(c.u2()):
            yield _row("module", "class", f.class_name(c.u2()), via="uses")
        for _ in range(c.u2()):
            yield _row("module", "class", f.class_name(c.u2()), via="provides")
            for _ in range(c.u2()):
                yield _row("module", "class", f.class_name(c.u2()), via="provides_with")

    def body(self, body: C.Code, member: int) -> Iterator[dict]:
        f = self.f
        for h in body.handlers:
            if h.type is not None:
                yield _row("exception", "class", h.type, member=member, bci=h.target, via="catch")
        yield from self.attributes(body.attributes, member, "code")
        for ins in body.instructions:
            if ins.cp is None:
                continue
            at = {"member": member, "bci": ins.bci, "cp": ins.cp, "opcode": ins.opcode}
            if ins.opcode in (178, 179, 180, 181):
                kind, *symbol = f.reference(ins.cp)
                yield _row("field", kind, *symbol, via="write" if ins.opcode in (179, 181) else "read", **at)
                yield from _types("type", C.descriptor_types(symbol[2]), "descriptor", **at)
            elif ins.opcode in (182, 183, 184, 185):
                kind, *symbol = f.reference(ins.cp)
                yield _row("invocation", kind, *symbol, via="call", **at)
                yield from _types("type", C.descriptor_types(symbol[2]), "descriptor", **at)
            elif ins.opcode == 186:
                yield from self.dynamic(ins.cp, at, ())
            elif ins.opcode in (187, 189, 192, 193, 197):
                yield from _types("type", _class_of(f, ins.cp), "instruction", **at)
            elif ins.opcode in (18, 19, 20):
                yield from self.loaded(ins.cp, at, ())

    def loaded(self, index: int, at: dict, path: tuple[int, ...]) -> Iterator[dict]:
        """A constant that an instruction or a bootstrap argument uses."""
        f = self.f
        tag = f.constant(index)[0]
        consumer = "bootstrap" if path else None
        if (lit := f.literal(index)) is not None:
            yield _row(consumer or "constant", "literal", literal=lit, via="argument" if path else "load", **at)
        elif tag == C.CLASS:
            yield from _types(consumer or "type", _class_of(f, index), "argument" if path else "class_constant", **at)
        elif tag == C.METHOD_TYPE:
            yield from _types(consumer or "type", C.descriptor_types(f.utf8(f.constant(index)[1])), "method_type", **at)
        elif tag == C.METHOD_HANDLE:
            kind, *symbol = f.reference(f.constant(index)[2])
            yield _row("bootstrap", kind, *symbol, via="argument_handle" if path else "handle", **at)
        elif tag == C.DYNAMIC:
            yield from self.dynamic(index, at, path)

    def dynamic(self, index: int, at: dict, path: tuple[int, ...]) -> Iterator[dict]:
        """The bootstrap handle and arguments behind a dynamic constant or call site; cycles end where they close."""
        f = self.f
        if index in path:
            self.problems.append("condy_cycle")
            return
        _, method, pair = f.constant(index, C.DYNAMIC, C.INVOKE_DYNAMIC)
        name, descriptor = f.pair(pair)
        yield _row("bootstrap", "call_site", None, name, descriptor, via="site" if not path else "nested_site", **at)
        yield from _types("type", C.descriptor_types(descriptor), "descriptor", **at)
        methods = C.bootstrap_methods(f)
        if method >= len(methods):
            raise C.Damaged("bootstrap_index", method)
        handle, given = methods[method]
        kind, *symbol = f.reference(f.constant(handle, C.METHOD_HANDLE)[2])
        yield _row("bootstrap", kind, *symbol, via="bootstrap_handle", **at)
        for g in given:
            yield from self.loaded(g, at, (*path, index))
