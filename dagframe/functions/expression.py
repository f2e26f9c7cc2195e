"""Expressions over records and collections, compiled once to columns and run on any number of frames.

An expression is built from the nodes below; names resolve to the nearest binding, then to the builtins. Functions exist only
while planning: a lambda becomes a Python function over columns, and applying it inlines it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dagframe.functions.builtins import Builtin, environment, number_text
from dagframe.functions.errors import ExpressionError, failing, guarded

Env = Mapping[str, Any]


class Node:
    def __call__(self, *args) -> Apply:
        return Apply(self, tuple(map(node, args)))

    def __getattr__(self, name: str) -> Field:
        if name.startswith("_"):
            raise AttributeError(name)
        return Field(self, name)

    def __getitem__(self, at) -> Index:
        return Index(self, node(at))

    def pipe(self, f) -> Apply:
        """x |> f is f x."""
        return Apply(node(f), (self,))


def node(x) -> Node:
    return x if isinstance(x, Node) else ListOf(tuple(map(node, x))) if isinstance(x, list) else Literal(x)


@dataclass(frozen=True)
class Literal(Node):
    value: Any


@dataclass(frozen=True)
class Var(Node):
    name: str


@dataclass(frozen=True)
class ListOf(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Record(Node):
    """Fields by path; a.b = 1 and a.c = 2 make one nested record."""

    fields: tuple[tuple[str, Node], ...]


@dataclass(frozen=True)
class Field(Node):
    of: Node
    name: str


@dataclass(frozen=True)
class Index(Node):
    of: Node
    at: Node


@dataclass(frozen=True)
class Lambda(Node):
    names: tuple[str, ...]
    body: Node


@dataclass(frozen=True)
class Apply(Node):
    f: Node
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Unary(Node):
    op: str
    x: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    a: Node
    b: Node


@dataclass(frozen=True)
class If(Node):
    condition: Node
    then: Node
    other: Node


@dataclass(frozen=True)
class Let(Node):
    bindings: tuple[tuple[str, Node], ...]
    body: Node


@dataclass(frozen=True)
class Text(Node):
    """An interpolated string."""

    parts: tuple[Node, ...]


def record(**fields) -> Record:
    return Record(tuple((k.replace("__", "."), node(v)) for k, v in fields.items()))


def fn(*names: str, body: Node) -> Lambda:
    if len(set(names)) < len(names):
        raise ExpressionError("DUPLICATE_PARAMETER", " ".join(names))
    return Lambda(names, body)


def let(body: Node, **bindings) -> Let:
    return Let(tuple((k, node(v)) for k, v in bindings.items()), body)


def op(sign: str, a, b) -> Binary:
    return Binary(sign, node(a), node(b))


@dataclass(frozen=True)
class Struct:
    """A record with statically known fields, so that merging and access need no runtime keys."""

    fields: dict[str, Any] = field(default_factory=dict)

    def column(self) -> Column:
        return F.struct(*(value(v).alias(k) for k, v in sorted(self.fields.items())))

    def merged(self, other: Struct) -> Struct:
        """Right wins, record by record."""
        out = dict(self.fields)
        for k, v in other.fields.items():
            out[k] = out[k].merged(v) if isinstance(v, Struct) and isinstance(out.get(k), Struct) else v
        return Struct(out)


def value(x) -> Column:
    """What a node came to, as a column."""
    if isinstance(x, Struct):
        return x.column()
    if isinstance(x, Column):
        return x
    raise ExpressionError("TYPE_MISMATCH", "a function is no value")


def divided(a: Column, b: Column) -> Column:
    """In double precision; a zero divisor and results that aren't finite fail the row."""
    x, y = a.cast("double"), b.cast("double")
    quotient = F.try_divide(x, y)
    finite = ~F.isnan(quotient) & (F.abs(quotient) < F.lit(float("inf")))
    return F.when(y == 0, failing("DIVISION_BY_ZERO", "zero divisor")).otherwise(guarded(finite, quotient, "NON_FINITE_DIVISION", "result is not finite"))


_BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divided,
    "==": lambda a, b: a.eqNullSafe(b), "!=": lambda a, b: ~a.eqNullSafe(b), "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    # CASE keeps the order of evaluation, AND and OR don't
    "&&": lambda a, b: F.when(a, b).otherwise(F.lit(False)), "||": lambda a, b: F.when(a, F.lit(True)).otherwise(b),
}


def _put(fields: dict, path: list[str], x) -> None:
    head, *rest = path
    if not rest:
        if head in fields:
            raise ExpressionError("DUPLICATE_PATH", head)
        fields[head] = x
        return
    inner = fields.setdefault(head, Struct({}))
    if not isinstance(inner, Struct):
        raise ExpressionError("DUPLICATE_PATH", head)
    _put(inner.fields, rest, x)


def compiled(n: Node, env: Env) -> Any:
    """A column, a Struct, or a Python function."""
    match n:
        case Literal(v):
            return F.lit(Decimal(str(v))) if isinstance(v, float) else F.lit(v)
        case Var(name):
            if name in env:
                return env[name]
            if name in environment():
                return environment()[name]
            raise ExpressionError("MISSING_VARIABLE", name)
        case ListOf(items):
            return F.array(*(value(compiled(i, env)) for i in items))
        case Record(fields):
            out: dict = {}
            for path, x in fields:
                _put(out, path.split("."), compiled(x, env))
            return Struct(out)
        case Field(of, name):
            x = compiled(of, env)
            if isinstance(x, Struct):
                if name not in x.fields:
                    raise ExpressionError("FIELD_MISSING", name)
                return x.fields[name]
            return value(x)[name]
        case Index(of, at):
            x, i = value(compiled(of, env)), value(compiled(at, env))
            return guarded((i >= 0) & (i < F.size(x)), F.get(x, i.cast("int")), "INDEX_OUT_OF_BOUNDS", "index")
        case Lambda(names, body):
            def run(*args, names=names, env=env):
                if len(args) > len(names):
                    raise ExpressionError("ARITY", " ".join(names))
                inner = {**env, **dict(zip(names, args, strict=False))}
                return compiled(body, inner) if len(args) == len(names) else compiled(Lambda(names[len(args) :], body), inner)

            return run
        case Apply(f, args):
            g = compiled(f, env)
            if not callable(g) or isinstance(g, (Column, Struct)):
                raise ExpressionError("FUNCTION_EXPECTED", str(f))
            given = []
            for a in args:
                x = compiled(a, env)
                if callable(x) and not isinstance(x, (Column, Struct)):
                    given.append(lambda *c, x=x: value(x(*c)))
                elif isinstance(a, Literal) and isinstance(g, Builtin) and g.name in ("split", "replace", "joinWith", "fromJson") and isinstance(a.value, str):
                    given.append(a.value)
                else:
                    given.append(value(x))
            return g(*given)
        case Unary(sign, x):
            c = value(compiled(x, env))
            return ~c if sign == "!" else -c
        case Binary("//", a, b):
            x, y = compiled(a, env), compiled(b, env)
            if isinstance(x, Struct) and isinstance(y, Struct):
                return x.merged(y)
            left, right = value(x), value(y)  # maps: right wins
            return F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right)
        case Binary(sign, a, b):
            return _BINARY[sign](value(compiled(a, env)), value(compiled(b, env)))
        case If(condition, then, other):
            return F.when(value(compiled(condition, env)), value(compiled(then, env))).otherwise(value(compiled(other, env)))
        case Let(bindings, body):
            inner = dict(env)
            seen: set[str] = set()
            for name, x in bindings:
                if name in seen:
                    raise ExpressionError("DUPLICATE_BINDING", name)
                seen.add(name)
                inner[name] = compiled(x, inner)
            return compiled(body, inner)
        case Text(parts):
            return F.concat(*(F.lit(p.value) if isinstance(p, Literal) and isinstance(p.value, str) else number_text(value(compiled(p, env))) for p in parts))
    raise ExpressionError("STATIC_SHAPE", type(n).__name__)


def projection(outputs: Mapping[str, Node], lets: Mapping[str, Node] | None = None, where: Record | None = None) -> Callable[[DataFrame], DataFrame]:
    """A node of output equations, compiled for a frame's columns: all outputs of a row or none.

    Lets see the inputs and earlier lets; the fields of `where` may shadow both."""

    prepared: dict[tuple[str, ...], list[Column]] = {}

    def compile_for(names: tuple[str, ...]) -> list[Column]:
        env: dict[str, Any] = {c: F.col(f"`{c}`") for c in names}
        for name, x in (lets or {}).items():
            env[name] = compiled(x, env)
        if where is not None:
            opened = compiled(where, env)
            if not isinstance(opened, Struct):
                raise ExpressionError("WHERE_NOT_RECORD", "where")
            env.update(opened.fields)
        return [value(compiled(x, env)).alias(port) for port, x in outputs.items()]

    def run(df: DataFrame) -> DataFrame:
        names = tuple(df.columns)
        if names not in prepared:
            prepared[names] = compile_for(names)
        return df.select(*prepared[names])

    return run


def bound_inputs(ports: Mapping[str, str], given: list[tuple[str | None, str, Any]]) -> dict[str, Any]:
    """Inputs by port. `ports` has the contract of each label, `given` (label or None, contract, value): a labelled one goes to its port, one
    without a label to the only port of its contract, and a single port without a name is called `in`."""
    out: dict[str, Any] = {}
    for label, contract, x in given:
        fits = [p for p, c in ports.items() if c == contract and (label is None or p == label)]
        if label is not None and label not in ports:
            raise ExpressionError("INPUT_UNKNOWN", label)
        if not fits:
            raise ExpressionError("INPUT_CONTRACT", contract)
        if len(fits) > 1 or fits[0] in out:
            raise ExpressionError("INPUT_NOT_CLEAR", contract)
        out[fits[0]] = x
    lacking = sorted(set(ports) - set(out))
    if lacking:
        raise ExpressionError("INPUT_LACKING", lacking[0])
    return {"in": next(iter(out.values()))} if list(ports) == [""] else out


def merged_settings(a: Any, b: Any) -> Any:
    """Settings known while planning: mappings merge into each other, right wins elsewhere."""
    if isinstance(a, Mapping) and isinstance(b, Mapping):
        return {k: merged_settings(a[k], b[k]) if k in a and k in b else b.get(k, a.get(k)) for k in {**a, **b}}
    return b


def joined_settings(a: Any, b: Any) -> Any:
    """Two texts or two lists, one after the other."""
    if type(a) is not type(b) or not isinstance(a, (str, list)):
        raise ExpressionError("TYPE_MISMATCH", "neither two texts nor two lists")
    return a + b
