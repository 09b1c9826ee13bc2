"""Java text of method bodies: statements, conditions and loops, with a source map.

Blocks whose values stay within them become statements; forward branches become if and if-else, back edges while and do-while.  What
has another shape (handlers, switches, subroutines, jumps out of loops, values that cross blocks, locals that outlive their
scope) falls back to a listing of its instructions, with the reason; a body is never guessed.  Segments
(start, end, bci) say which characters come from which instruction.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from . import classfile as C
from .dataflow import GOTO, RETURNS, Refused, control_flow

#: Operators of arithmetic opcodes, four of a kind (int, long, float, double) from 96 on.
ARITHMETIC = ["+", "-", "*", "/", "%"]
SHIFTS = ["<<", ">>", ">>>", "&", "|", "^"]
CASTS = {133: "long", 134: "float", 135: "double", 136: "int", 137: "float", 138: "double", 139: "int", 140: "long", 141: "double", 142: "int", 143: "long", 144: "float",
         145: "byte", 146: "char", 147: "short"}
PRIMITIVE = {b"B": "byte", b"C": "char", b"D": "double", b"F": "float", b"I": "int", b"J": "long", b"S": "short", b"Z": "boolean", b"V": "void"}
COMPARE = ["==", "!=", "<", ">=", ">", "<="]
ELEMENTS = ["boolean", "char", "float", "double", "byte", "short", "int", "long"]


class Unrecovered(Exception):
    pass


class Bool(str):
    """Text of a boolean value: used as a condition without a comparison."""


@dataclass
class Compared:
    """The pending result of a three-way comparison; nan is what it gives for NaN (0: integers)."""

    left: str
    right: str
    nan: int


def type_name(descriptor: bytes) -> str:
    depth = len(descriptor) - len(descriptor.lstrip(b"["))
    inner = descriptor[depth:]
    plain = PRIMITIVE[inner] if inner in PRIMITIVE else C.display(inner[1:-1]).replace("/", ".").replace("$", ".")
    return plain + "[]" * depth


def class_name(raw: bytes) -> str:
    return type_name(raw if raw.startswith(b"[") else b"L" + raw + b";")


def text_literal(raw: bytes) -> str:
    marks = {"\n": "\\n", "\t": "\\t", "\r": "\\r", '"': '\\"', "\\": "\\\\"}
    return '"' + "".join(marks.get(c, c if c.isprintable() else f"\\u{ord(c):04x}") for c in C.display(raw)) + '"'


def literal(row: dict) -> str:
    kind, bits = row["lit_kind"], row["lit_bits"]
    if kind == "string":
        return text_literal(row["lit_utf"])
    if kind == "int":
        return str(bits)
    if kind == "long":
        return f"{bits}L"
    if kind in ("float", "double"):
        value = struct.unpack(">f", struct.pack(">I", bits))[0] if kind == "float" else struct.unpack(">d", struct.pack(">q", bits))[0]
        owner = "Float" if kind == "float" else "Double"
        if value != value:
            return f"{owner}.NaN"
        if value in (float("inf"), float("-inf")):
            return f"{owner}.{'POSITIVE' if value > 0 else 'NEGATIVE'}_INFINITY"
        return f"{value!r}{'f' if kind == 'float' else ''}"
    if row["tag"] == "class":
        return class_name(row["owner"]) + ".class"
    raise Unrecovered("constant_kind")


def negated(condition: str) -> str:
    return condition[1:] if condition.startswith("!") else f"!{condition}"


def recover(code: list[dict], handlers: list[dict], constants: dict[int, dict], descriptor: bytes, static: bool, this_class: bytes | None = None) -> dict:
    """{text, representation (java or listing), reason, segments}."""
    try:
        if handlers:
            raise Unrecovered("exception_handlers")
        lines = _Body(code, constants, descriptor, static, this_class).lines()
        kind, reason = "java", None
    except (Unrecovered, Refused, C.Damaged, IndexError, KeyError) as e:
        lines = [(i["bci"], f"/* {i['bci']}: opcode {i['opcode']}{'' if i['cp_index'] is None else f' #{i['cp_index']}'} */") for i in code]
        kind, reason = "listing", str(e) if isinstance(e, Unrecovered) else e.code if isinstance(e, Refused) else "not_expressed"
    text, segments = "", []
    for bci, line in lines:
        if bci is not None:
            segments.append({"start": len(text), "end": len(text) + len(line), "bci": bci})
        text += line + "\n"
    return {"text": text, "representation": kind, "reason": reason, "segments": segments}


@dataclass
class _Block:
    statements: list[tuple[int, str]] = field(default_factory=list)
    end: str = "fall"  # fall, goto, leave or branch
    condition: str = ""  # of the jump
    target: int = -1
    at: int = -1


class _Body:
    def __init__(self, code: list[dict], constants: dict[int, dict], descriptor: bytes, static: bool, this_class: bytes | None):
        self.constants, self.this_class = constants, this_class
        given, self.result = C.arguments(descriptor)
        self.names: dict[int, str] = {} if static else {0: "this"}
        n = len(self.names)
        for k, a in enumerate(given):
            self.names[n] = Bool(f"p{k}") if a == b"Z" else f"p{k}"
            n += 2 if a in (b"J", b"D") else 1
        self.parameters = set(self.names)
        if any(i["opcode"] in (168, 169, 170, 171, 201) for i in code):
            raise Unrecovered("switch" if any(i["opcode"] in (170, 171) for i in code) else "subroutine")
        ranges, _ = control_flow(code, [])
        self.starts = [a for a, _ in ranges]
        self.last = code[-1]["bci"] if code else -1
        self.scope: tuple[int, ...] = ()
        self.homes: dict[int, tuple[int, ...]] = {}
        self.code = [[i for i in code if a <= i["bci"] < b] for a, b in ranges]
        self.out: list[tuple[int | None, str]] = []
        self.depth = 0

    # -- structure
    def lines(self) -> list[tuple[int | None, str]]:
        self.region(0, len(self.code), ())
        return self.out

    def put(self, bci: int | None, text: str) -> None:
        self.out.append((bci, "    " * self.depth + text))

    def index(self, start: int) -> int:
        return self.starts.index(start)

    def back_to(self, k: int, j: int) -> int | None:
        """The last block in [k, j) that jumps back to block k."""
        found = None
        for e in range(k, j):
            last = self.code[e][-1]
            if self.starts[k] in last["targets"] and last["bci"] >= self.starts[k]:
                found = e
        return found

    def inside(self, i: int, j: int, scope: tuple[int, ...], skip: bool = False) -> None:
        self.depth += 1
        self.region(i, j, scope, skip)
        self.depth -= 1

    def region(self, i: int, j: int, scope: tuple[int, ...], skip: bool = False) -> None:
        """Blocks i to j-1, which leave for block j only; skip: the last one's final goto belongs to what is around."""
        k = i
        while k < j:
            end = self.back_to(k, j) if not (skip and k == i and self.code[k][-1]["targets"] == (self.starts[k],)) else None
            if end is not None and self.open_loop != (k, end):
                k = self.loop(k, end, j, scope)
                continue
            block = self.block(k, scope)
            for line in block.statements:
                self.put(*line)
            if block.end == "leave":
                k += 1
                if k < j and not self.entered(k, i, j):
                    raise Unrecovered("unreachable")
                continue
            if block.end == "goto":
                if not (k == j - 1 and (skip or (j < len(self.starts) and block.target == self.starts[j]))):
                    raise Unrecovered("jump")
                k += 1
                continue
            if block.end == "branch":
                k = self.branch(k, j, block, scope)
                continue
            k += 1

    open_loop: tuple[int, int] | None = None

    def entered(self, k: int, i: int, j: int) -> bool:
        return any(self.starts[k] in b[-1]["targets"] for b in self.code[i:j])

    def branch(self, k: int, j: int, block: _Block, scope: tuple[int, ...]) -> int:
        """if and if-else: the jump goes forward, over what runs when its condition is false."""
        if block.target <= self.starts[k]:
            raise Unrecovered("loop_transfer")
        t = self.index(block.target)
        if t > j:
            raise Unrecovered("jump")
        last = self.code[t - 1][-1]
        other = t
        if t - 1 > k and last["opcode"] in (GOTO, 200) and last["targets"][0] > last["bci"]:
            other = self.index(last["targets"][0])
        if other > j:
            raise Unrecovered("jump")
        self.put(block.at, f"if ({negated(block.condition)}) {{")
        self.inside(k + 1, t, (*scope, 2 * k), other > t)
        if other > t:
            self.put(None, "} else {")
            self.inside(t, other, (*scope, 2 * k + 1))
        self.put(None, "}")
        return other

    def loop(self, k: int, end: int, j: int, scope: tuple[int, ...]) -> int:
        """while, where the head tests and leaves; do-while, where the end tests and comes back."""
        inner = (*scope, -2 * k - 1)
        last = self.code[end][-1]
        if last["opcode"] in (GOTO, 200):
            head = self.block(k, inner)
            after = self.starts[end + 1] if end + 1 < len(self.starts) else None
            if head.statements or head.end != "branch" or head.target != after or end == k:
                raise Unrecovered("loop_shape")
            self.put(head.at, f"while ({negated(head.condition)}) {{")
            self.inside(k + 1, end + 1, inner, True)
        else:
            self.put(None, "do {")
            self.depth += 1
            held, self.open_loop = self.open_loop, (k, end)
            self.region(k, end, inner)
            self.open_loop = held
            tail = self.block(end, inner)
            for line in tail.statements:
                self.put(*line)
            self.depth -= 1
            if tail.end != "branch" or tail.target != self.starts[k]:
                raise Unrecovered("loop_shape")
            self.put(tail.at, f"}} while ({tail.condition});")
            return end + 1
        self.put(None, "}")
        return end + 1

    # -- values
    def local(self, n: int, store: bool, scope: tuple[int, ...]) -> tuple[str, bool]:
        """(name, whether it is declared here); a local lives in the scope of its first store."""
        if n in self.parameters:
            return self.names[n], False
        home = self.homes.get(n)
        if home is None:
            if not store:
                raise Unrecovered("local_scope")
            self.homes[n] = scope
            return f"v{n}", True
        if scope[: len(home)] != home:
            raise Unrecovered("local_scope")
        return f"v{n}", False

    def block(self, k: int, scope: tuple[int, ...]) -> _Block:
        out, stack = _Block(), []
        say = lambda at, text: out.statements.append((at, text))

        def pop() -> str:
            value = stack.pop()
            if isinstance(value, Compared):
                raise Unrecovered("comparison_value")
            return value

        for ins in self.code[k]:
            op, at = ins["opcode"], ins["bci"]
            row = self.constants.get(ins["cp_index"]) if ins["cp_index"] is not None else None
            if op == 196:
                op = ins["value"]
            if op == 0:
                continue
            if op == 1:
                stack.append("null")
            elif 2 <= op <= 8:
                stack.append(str(op - 3))
            elif 9 <= op <= 15:
                stack.append(["0L", "1L", "0.0f", "1.0f", "2.0f", "0.0", "1.0"][op - 9])
            elif op in (16, 17):
                stack.append(str(ins["value"]))
            elif op in (18, 19, 20):
                stack.append(literal(row))
            elif 21 <= op <= 45:
                stack.append(self.local(ins["local"], False, scope)[0])
            elif 46 <= op <= 53:
                index, array = pop(), pop()
                stack.append(f"{array}[{index}]")
            elif 54 <= op <= 78:
                value = pop()
                name, fresh = self.local(ins["local"], True, scope)
                _pure(stack, name)
                say(at, f"{'var ' if fresh else ''}{name} = {value};")
            elif 79 <= op <= 86:
                value, index, array = pop(), pop(), pop()
                _pure(stack)
                say(at, f"{array}[{index}] = {value};")
            elif op in (87, 88):
                value = pop()
                if value.endswith(")"):
                    _pure(stack)
                    say(at, f"{value};")
            elif op == 89:
                if not (isinstance(stack[-1], str) and (stack[-1].startswith("new ") or stack[-1].isidentifier())):
                    raise Unrecovered("duplicated_value")
                stack.append(stack[-1])
            elif 96 <= op <= 115:
                b, a = pop(), pop()
                stack.append(f"({a} {ARITHMETIC[(op - 96) // 4]} {b})")
            elif 116 <= op <= 119:
                stack.append(f"(-{pop()})")
            elif 120 <= op <= 131:
                b, a = pop(), pop()
                stack.append(f"({a} {SHIFTS[(op - 120) // 2]} {b})")
            elif op == 132:
                if stack or ins["opcode"] == 196:
                    raise Unrecovered("increment")
                say(at, f"{self.local(ins['local'], False, scope)[0]} += {ins['value']};")
            elif op in CASTS:
                stack.append(f"(({CASTS[op]}) {pop()})")
            elif 148 <= op <= 152:
                b, a = pop(), pop()
                stack.append(Compared(a, b, (0, -1, 1, -1, 1)[op - 148]))
            elif 153 <= op <= 166 or op in (198, 199):
                out.condition = self.condition(op, stack, pop)
                out.end, out.target, out.at = "branch", ins["targets"][0], at
            elif op in (GOTO, 200):
                out.end, out.target, out.at = "goto", ins["targets"][0], at
            elif op in (178, 180):
                text = (class_name(row["owner"]) if op == 178 else pop()) + "." + C.display(row["name"])
                stack.append(Bool(text) if row["descriptor"] == b"Z" else text)
            elif op in (179, 181):
                value = pop()
                owner = class_name(row["owner"]) if op == 179 else pop()
                _pure(stack)
                say(at, f"{owner}.{C.display(row['name'])} = {_as(value, row['descriptor'])};")
            elif 182 <= op <= 185:
                self.call(op, at, row, stack, pop, say)
            elif op == 187:
                stack.append(f"new {class_name(row['owner'])}")
            elif op == 188:
                stack.append(f"new {ELEMENTS[ins['value'] - 4]}[{pop()}]")
            elif op == 189:
                stack.append(f"new {class_name(row['owner'])}[{pop()}]")
            elif op == 190:
                stack.append(f"{pop()}.length")
            elif op == 191:
                say(at, f"throw {pop()};")
                out.end = "leave"
            elif op == 192:
                stack.append(f"(({class_name(row['owner'])}) {pop()})")
            elif op == 193:
                stack.append(Bool(f"({pop()} instanceof {class_name(row['owner'])})"))
            elif op == 177:
                if at != self.last:
                    say(at, "return;")
                out.end = "leave"
            elif op in RETURNS:
                say(at, f"return {_as(pop(), self.result)};")
                out.end = "leave"
            else:
                raise Unrecovered(f"opcode_{op}")
        if stack and not (out.end == "leave" and all(isinstance(x, str) and "(" not in x for x in stack)):
            raise Unrecovered("value_across_blocks")
        return out

    def condition(self, op: int, stack: list, pop) -> str:
        if op in (198, 199):
            return f"({pop()} {'==' if op == 198 else '!='} null)"
        if op >= 159:
            b, a = pop(), pop()
            return f"({a} {(COMPARE * 2)[op - 159]} {b})"
        sign = COMPARE[op - 153]
        top = stack.pop()
        if isinstance(top, Compared):
            opposite = COMPARE[(op - 153) ^ 1]
            nan_jumps = top.nan and {"==": False, "!=": True, "<": top.nan < 0, ">=": top.nan > 0, ">": top.nan > 0, "<=": top.nan < 0}[sign]
            return f"!({top.left} {opposite} {top.right})" if nan_jumps else f"({top.left} {sign} {top.right})"
        if isinstance(top, Bool):
            if sign not in ("==", "!="):
                raise Unrecovered("boolean_order")
            return negated(top) if sign == "==" else str(top)
        return f"({top} {sign} 0)"

    def call(self, op: int, at: int, row: dict, stack: list, pop, say) -> None:
        given, result = C.arguments(row["descriptor"])
        values = [pop() for _ in given][::-1]
        text = ", ".join(_as(v, d) for v, d in zip(values, given, strict=True))
        name = C.display(row["name"])
        owner = class_name(row["owner"]) if op == 184 else pop()
        if name == "<init>":
            if owner == "this":
                say(at, f"{'this' if row['owner'] == self.this_class else 'super'}({text});")
            elif stack and stack[-1] == owner and owner.startswith("new "):
                stack[-1] = f"{owner}({text})"
            else:
                raise Unrecovered("constructor")
            return
        call = f"{owner}.{name}({text})"
        if result == b"V":
            _pure(stack)
            say(at, call + ";")
        else:
            stack.append(Bool(call) if result == b"Z" else call)


def _as(value: str, descriptor: bytes) -> str:
    """Constants 0 and 1 where a boolean is meant."""
    return {"0": "false", "1": "true"}.get(value, value) if descriptor == b"Z" else value


def _pure(stack: list, written: str | None = None) -> None:
    """A statement must not overtake calls or reads whose values are still on the stack, nor change a local that one names."""
    if any(isinstance(x, Compared) or any(mark in x for mark in "([.") or (written is not None and x == written) for x in stack):
        raise Unrecovered("evaluation_order")
