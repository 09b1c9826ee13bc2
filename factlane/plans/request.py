"""Requests, limits and reports: validated on the driver before anything is read."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, replace

SCHEMA_VERSION = 1
RELATIONS = ("constant_pool_contains", "mentions_symbol", "literal_value", "owner_candidates", "member_shape", "references_definition", "may_dispatch_to")
#: Relations that a structural scan cannot answer; they say so instead of guessing.
UNSUPPORTED = ("references_definition", "may_dispatch_to")
CONSUMERS = ("invocation", "field", "type", "constant", "exception", "signature", "annotation", "inner_nest", "module", "bootstrap", "resource")
#: Dimensions whose usage is the highest value and not the sum.
HIGH_WATER = ("nested_depth", "dependency_depth")


class InvalidInput(ValueError):
    """A request that cannot be carried out; ``code`` says why."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


class BudgetExceeded(RuntimeError):
    def __init__(self, dimension: str, limit: int, consumed: int, requested: int):
        super().__init__(f"{dimension}: {consumed} + {requested} > {limit}")
        self.dimension, self.limit, self.consumed, self.requested = dimension, limit, consumed, requested


@dataclass(frozen=True)
class Limits:
    """Bounds of the dimensions that an operation charges; None: no bound."""

    input_bytes: int | None = None
    archive_entries: int | None = None
    entry_bytes: int | None = None
    read_bytes: int | None = None
    class_bytes: int | None = None
    attribute_bytes: int | None = None
    code_bytes: int | None = None
    result_items: int | None = None
    output_bytes: int | None = None
    class_headers: int | None = None
    method_bodies: int | None = None
    ir_items: int | None = None
    ir_edges: int | None = None
    analysis_steps: int | None = None
    normalization_clones: int | None = None
    nested_depth: int | None = None
    dependency_depth: int | None = None
    elapsed_millis: int | None = None

    def override(self, **changes: int) -> Limits:
        known = {f.name for f in fields(self)}
        for name, value in changes.items():
            if name not in known:
                raise InvalidInput("unknown_dimension")
            if not isinstance(value, int) or value < 0:
                raise InvalidInput("bad_limit")
        return replace(self, **changes)


@dataclass
class Budget:
    """What an operation has used; charges are refused before the work, and a cancellation outranks every bound.

    Operations that share a ledger each have a budget with the ledger's as its parent: a charge must fit both, and the
    first refusal anywhere stops all of them.
    """

    limits: Limits = field(default_factory=Limits)
    used: dict[str, int] = field(default_factory=dict)
    cancelled: bool = False
    parent: Budget | None = None
    first_stop: BudgetExceeded | None = None

    def child(self, limits: Limits | None = None) -> Budget:
        """The budget of one of the operations that share this one."""
        return Budget(limits or Limits(), parent=self)

    def poll(self) -> None:
        """Raise if this operation, or one that it shares a ledger with, must not go on."""
        if self.cancelled:
            raise InterruptedError("cancelled")
        if self.parent is not None:
            self.parent.poll()
            if self.parent.first_stop is not None:
                raise self.parent.first_stop

    def _fits(self, dimension: str, amount: int) -> int:
        limit, have = getattr(self.limits, dimension), self.used.get(dimension, 0)
        now = max(have, amount) if dimension in HIGH_WATER else have + amount
        if limit is not None and now > limit:
            stop = BudgetExceeded(dimension, limit, have, amount)
            self.first_stop = self.first_stop or stop
            if self.parent is not None:
                self.parent.first_stop = self.parent.first_stop or stop
            raise stop
        return now

    def charge(self, dimension: str, amount: int) -> None:
        """Either all of the ledger's budgets take the amount, or none."""
        self.poll()
        line = [self]
        while line[-1].parent is not None:
            line.append(line[-1].parent)
        totals = [b._fits(dimension, amount) for b in line]
        for b, now in zip(line, totals, strict=True):
            b.used[dimension] = now

    def cancel(self) -> None:
        self.cancelled = True


@dataclass(frozen=True)
class Symbol:
    """A symbolic class, field or method; names as raw bytes or text."""

    kind: str
    owner: bytes | str | None = None
    name: bytes | str | None = None
    descriptor: bytes | str | None = None

    def parts(self) -> dict[str, bytes | None]:
        raw = lambda x: x.encode() if isinstance(x, str) else x
        return {"owner": raw(self.owner), "name": raw(self.name), "descriptor": raw(self.descriptor)}


@dataclass(frozen=True)
class Literal:
    """A typed constant: integers by value, floating point by bits, strings by raw bytes."""

    kind: str
    bits: int | None = None
    utf: bytes | None = None


@dataclass(frozen=True)
class QueryRequest:
    relation: str
    target: Symbol | Literal
    snapshot: str | None = None  # None: all
    container: str | None = None
    consumers: tuple[str, ...] = ()  # none: all of them
    consumer_version: int = SCHEMA_VERSION
    max_items: int = 0  # no page limit
    cursor: str | None = None

    def validated(self) -> QueryRequest:
        if self.relation not in RELATIONS:
            raise InvalidInput("unknown_relation")
        if self.consumer_version != SCHEMA_VERSION:
            raise InvalidInput("consumer_schema_version")
        if any(c not in CONSUMERS for c in self.consumers):
            raise InvalidInput("unknown_consumer")
        if self.max_items < 0:
            raise InvalidInput("bad_page_size")
        if (self.relation == "literal_value") != isinstance(self.target, Literal):
            raise InvalidInput("target_kind")
        return replace(self, consumers=tuple(sorted(set(self.consumers))))

    def identity(self) -> str:
        """What a cursor belongs to: everything that decides the rows, but neither page size nor budget."""
        return hashlib.sha256(json.dumps(asdict(replace(self.validated(), max_items=0, cursor=None)), sort_keys=True, default=repr).encode()).hexdigest()

    def position(self) -> tuple | None:
        if self.cursor is None:
            return None
        try:
            held = json.loads(base64.urlsafe_b64decode(self.cursor))
            digest, position = held["request"], tuple(held["after"])
        except (ValueError, KeyError, TypeError) as e:
            raise InvalidInput("query_cursor_malformed") from e
        if digest != self.identity():
            raise InvalidInput("query_cursor_mismatch")
        return position

    def next_cursor(self, position: tuple) -> str:
        return base64.urlsafe_b64encode(json.dumps({"request": self.identity(), "after": list(position)}).encode()).decode()
