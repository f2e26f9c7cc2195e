"""Flows: typed nodes put together by matching (label, contract) ports, run over frames.

A Flow is a description; running it hands frames from port to port, so that Spark sees one plan for each exit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Port = tuple[str, str]  # label, contract


class FlowError(ValueError):
    pass


@dataclass(frozen=True)
class FlowNode:
    name: str
    takes: tuple[Port, ...]
    gives: tuple[Port, ...]
    run: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


@dataclass(frozen=True)
class Flow:
    nodes: tuple[FlowNode, ...] = ()
    #: (from node, label, to node, label)
    links: tuple[tuple[str, str, str, str], ...] = ()

    def _ports(self, way: str) -> list[tuple[str, Port]]:
        used = {(x[0], x[1]) for x in self.links} if way == "gives" else {(x[2], x[3]) for x in self.links}
        return [(n.name, p) for n in self.nodes for p in getattr(n, way) if (n.name, p[0]) not in used]

    @property
    def entries(self) -> list[tuple[str, Port]]:
        return self._ports("takes")

    @property
    def exits(self) -> list[tuple[str, Port]]:
        return self._ports("gives")

    def __or__(self, other: Flow) -> Flow:
        """Side by side."""
        twice = {n.name for n in self.nodes} & {n.name for n in other.nodes}
        if twice:
            raise FlowError(f"nodes used twice: {sorted(twice)}")
        return Flow(self.nodes + other.nodes, self.links + other.links)

    def __rshift__(self, other: Flow) -> Flow:
        """One after the other: exits meet entries of the same label and contract, one to one; others stay open."""
        if not self.nodes or not other.nodes:
            return self | other
        both = self | other
        out, into = Counter(p for _, p in self.exits), Counter(p for _, p in other.entries)
        unclear = [p for p in out if p in into and (out[p] > 1 or into[p] > 1)]
        if unclear:
            raise FlowError(f"ambiguous ports: {unclear}")
        ends = {p: name for name, p in other.entries}
        made = tuple((name, p[0], ends[p], p[0]) for name, p in self.exits if p in ends)
        return Flow(both.nodes, both.links + made)

    def checked(self) -> list[str]:
        """Nodes in an order that runs; a cycle or a flow in several pieces is an error."""
        before = {n.name: {a for a, _, b, _ in self.links if b == n.name} for n in self.nodes}
        order: list[str] = []
        while len(order) < len(before):
            free = sorted(n for n, b in before.items() if n not in order and b <= set(order))
            if not free:
                raise FlowError(f"cycle among {sorted(set(before) - set(order))}")
            order += free
        reach, todo = set(), order[:1]
        while todo:
            n = todo.pop()
            if n not in reach:
                reach.add(n)
                todo += [b if a == n else a for a, _, b, _ in self.links if n in (a, b)]
        if len(reach) < len(order):
            raise FlowError(f"not connected: {sorted(set(order) - reach)}")
        return order

    def run(self, **inputs: DataFrame) -> dict[str, DataFrame]:
        missing = [p[0] for _, p in self.entries if p[0] not in inputs]
        if missing:
            raise FlowError(f"no input for {missing}")
        nodes, made, out = {n.name: n for n in self.nodes}, {}, {}
        for name in self.checked():
            given = {label: made.get(next(((a, p) for a, p, b, q in self.links if (b, q) == (name, label)), None), inputs.get(label)) for label, _ in nodes[name].takes}
            results = nodes[name].run(given)
            if set(results) != {label for label, _ in nodes[name].gives}:
                raise FlowError(f"{name} gave {sorted(results)}")
            made |= {(name, label): df for label, df in results.items()}
        for name, (label, _) in self.exits:
            out.setdefault(label, made[name, label])  # of several exits of one label the leftmost node's counts
        return out

    def endpoint_report(self) -> list[tuple[str, str, str, str]]:
        """Each port with what became of it: (node, way, label, use)."""
        rows = []
        for n in self.nodes:
            rows += [(n.name, "in", label, "edge" if any((b, q) == (n.name, label) for _, _, b, q in self.links) else "input") for label, _ in n.takes]
            rows += [(n.name, "out", label, "edge" if any((a, p) == (n.name, label) for a, p, _, _ in self.links) else "result") for label, _ in n.gives]
        return rows


@dataclass
class Registry:
    """Contracts, and functions that nodes may name."""

    contracts: dict[str, dict] = field(default_factory=dict)
    executors: dict[str, Callable] = field(default_factory=dict)

    def node(self, name: str, takes: dict[str, str], gives: dict[str, str], run: Callable | str) -> Flow:
        for c in (*takes.values(), *gives.values()):
            if c not in self.contracts:
                raise FlowError(f"unknown contract {c}")
        if isinstance(run, str):
            if run not in self.executors:
                raise FlowError(f"unknown executor {run}")
            run = self.executors[run]
        return Flow((FlowNode(name, tuple(takes.items()), tuple(gives.items()), run),))


def make(count: int, build: Callable[[int], Flow]) -> Flow:
    out = Flow()
    for k in range(count):
        out = out | build(k)
    return out


def family(count: int, build: Callable[[int], Flow]) -> list[Flow]:
    """The same, with each member at its index."""
    return [build(k) for k in range(count)]


def plain_label(text: str) -> str:
    """A label of letters, digits and _, as `sanitised` makes it of a column."""
    plain = "".join(c if c.isascii() and c.isalnum() else "_" for c in text).lstrip("_")
    return plain if plain[:1].isalpha() else f"item_{plain}"


def make_each(items: dict[str, object], build: Callable[[str, object], Flow]) -> Flow:
    out, seen = Flow(), {}
    for given, item in items.items():
        label = plain_label(given)
        if label in seen:
            raise FlowError(f"{given} and {seen[label]} are both {label}")
        seen[label] = given
        out = out | build(label, item)
    return out


def gathered(df: DataFrame, into: str, *fields: str) -> DataFrame:
    return df.select(*(c for c in df.columns if c not in fields), F.struct(*fields).alias(into))


def scattered(df: DataFrame, record: str) -> DataFrame:
    return df.select(*(c for c in df.columns if c != record), f"{record}.*")


def selected(df: DataFrame, tag: Column, arms: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each row through the arm of its tag; arms come to one common schema. A row-level form of a choice between variants."""
    out = None
    for name, arm in arms.items():
        part = arm(df.where(tag == name))
        out = part if out is None else out.unionByName(part)
    # A row of no arm fails the run; it can't be left out.
    lost = df.where(~F.coalesce(tag.isin(*arms), F.lit(False)))
    refused = F.raise_error(F.concat(F.lit("no arm for "), F.coalesce(tag.cast("string"), F.lit("null"))))
    return out.unionByName(lost.select(*(refused.cast(f.dataType).alias(f.name) for f in out.schema.fields)))


def port_matches(exits: DataFrame, entries: DataFrame) -> DataFrame:
    """Ports (label, contract) of both sides: joined, or open as an exit or an entry; several of one side are ambiguous."""
    a, b = (df.groupBy("label", "contract").agg(F.count("*").alias(n)) for df, n in ((exits, "a"), (entries, "b")))
    side = F.when(F.col("a").isNull(), "entry").when(F.col("b").isNull(), "exit").when((F.col("a") > 1) | (F.col("b") > 1), "ambiguous").otherwise("joined")
    return a.join(b, ["label", "contract"], "full_outer").select("label", "contract", side.alias("side"))


def compatible(sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """Of sinks (sink, accepts: contracts), how many sources (source, contract) fit: none, one or many."""
    each = sinks.select("sink", F.explode(F.array_distinct("accepts")).alias("contract"))
    n = each.join(sources, "contract").groupBy("sink").agg(F.count("*").alias("n"))
    out = sinks.select("sink").join(n, "sink", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("sink", "n", F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "one").otherwise("many").alias("fit"))


def unused_nodes(declared: DataFrame, used: DataFrame) -> DataFrame:
    return declared.select("node").distinct().join(used.select("node"), "node", "left_anti")


def grouped_values(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Values of each contract or producer as one list, in order."""
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("held"))
