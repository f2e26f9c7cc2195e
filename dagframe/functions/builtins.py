"""The closed environment of 49 functions over values and nested collections, data last, as Spark columns.

Each takes and gives columns (functions among the arguments are Python functions over columns), so that a whole program is
one projection that Catalyst plans. Arguments that a Spark function would treat leniently are guarded.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from dagframe.functions.errors import ExpressionError, guarded

Fn = Callable[..., Column]
#: Bound on the span of a range and on the size of what a fold carries.
BOUND = 1_000_000


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def map_(f: Fn, xs: Column) -> Column:
    return F.transform(xs, lambda x: f(x))


def filter_(p: Fn, xs: Column) -> Column:
    return F.filter(xs, lambda x: p(x))


def _even(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)


def zip_(a: Column, b: Column) -> Column:
    return F.zip_with(*_even(a, b), lambda x, y: F.struct(x.alias("fst"), y.alias("snd")))


def zip_with(f: Fn, a: Column, b: Column) -> Column:
    return F.zip_with(*_even(a, b), lambda x, y: f(x, y))


def length(xs: Column) -> Column:
    return F.size(xs).cast("long")


def sum_(xs: Column) -> Column:
    """Exact to 18 decimals."""
    return F.aggregate(xs, F.lit(0).cast("decimal(37,18)"), lambda a, x: (a + x.cast("decimal(37,18)")).cast("decimal(37,18)"))


def all_(p: Fn, xs: Column) -> Column:
    return F.forall(xs, lambda x: p(x))


def any_(p: Fn, xs: Column) -> Column:
    return F.exists(xs, lambda x: p(x))


def min_(a: Column, b: Column) -> Column:
    return F.when(_c(a) <= _c(b), _c(a)).otherwise(_c(b))


def max_(a: Column, b: Column) -> Column:
    return F.when(_c(a) >= _c(b), _c(a)).otherwise(_c(b))


def clamp(low: Column, high: Column, x: Column) -> Column:
    return F.greatest(_c(low), F.least(_c(high), _c(x)))


def concat(xs: Column) -> Column:
    return F.array_join(xs, "")


def number_text(x: Column) -> Column:
    """A decimal without trailing zeros, never in exponent form."""
    text = _c(x).cast("string")
    plain = F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return F.when(plain == "-0", F.lit("0")).otherwise(plain)


def to_string(x: Column) -> Column:
    return number_text(x)


def join_with(separator: Column, xs: Column) -> Column:
    return F.array_join(xs, separator) if isinstance(separator, str) else F.call_function("array_join", xs, _c(separator))


def to_json(x: Column) -> Column:
    """Keys sorted, no white space, numbers in their shortest fixed form."""
    return F.to_json(F.parse_json(F.to_json(x)))


def from_json(schema: str, text: Column) -> Column:
    return guarded(F.try_parse_json(text).isNotNull(), F.from_json(text, schema), "JSON_PARSE", "not a JSON text")


def bound(x: Column, f: Fn) -> Column:
    """f of x, which is worked out once a row; Spark would work it out wherever a lambda names it, once an element."""
    return F.get(F.transform(F.array(x), lambda v: f(v)), F.lit(0))


def _sorted_rows(row: Fn, xs: Column) -> Column:
    """xs in the order of row(x, place), a struct that ends with the place as i. Its fields are best flat: a struct inside it made sorts several times dearer."""
    return bound(xs, lambda v: F.transform(F.sort_array(F.transform(v, lambda x, i: row(x, i.alias("i")))), lambda e: F.get(v, e["i"])))


def sort_by(key: Fn, xs: Column) -> Column:
    """Stable: equal keys keep their order, which goes into the sort as their second key."""
    return _sorted_rows(lambda x, i: F.struct(key(x).alias("k"), i), xs)


def _bounded(n: Column, xs: Column) -> Column:
    whole = _c(n).cast("double") == F.floor(_c(n).cast("double"))
    return guarded(whole, F.greatest(F.lit(0), F.least(F.floor(_c(n).cast("double")).cast("long"), F.size(xs))).cast("int"), "TYPE_MISMATCH", "not a whole number")


def take(n: Column, xs: Column) -> Column:
    return F.slice(xs, F.lit(1), _bounded(n, xs))


def drop(n: Column, xs: Column) -> Column:
    return F.slice(xs, _bounded(n, xs) + 1, F.size(xs))


def enumerate_(xs: Column) -> Column:
    return F.transform(xs, lambda x, i: F.struct(i.alias("index"), x.alias("value")))


def map_indexed(f: Fn, xs: Column) -> Column:
    return F.transform(xs, lambda x, i: f(i, x))


def find(p: Fn, xs: Column) -> Column:
    return F.get(F.filter(xs, lambda x: p(x)), F.lit(0))


def find_index(p: Fn, xs: Column) -> Column:
    return (F.array_position(F.transform(xs, lambda x: p(x)), True) - 1).cast("long")


def contains(x: Column, xs: Column) -> Column:
    return F.exists(xs, lambda y: y.eqNullSafe(x))


def index_of(x: Column, xs: Column) -> Column:
    return find_index(lambda y: y.eqNullSafe(x), xs)


def count(p: Fn, xs: Column) -> Column:
    return F.size(F.filter(xs, lambda x: p(x))).cast("long")


def split(separator: str, text: Column) -> Column:
    if separator == "":
        return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))
    quoted = "".join(f"\\{c}" if c in r"\.[]{}()*+?^$|" else c for c in separator)
    return F.split(text, quoted, -1)


def replace(old: str, new: str, text: Column) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def substring(start: Column, end: Column, text: Column) -> Column:
    low = F.greatest(F.lit(0), F.least(_c(start), F.length(text)))
    high = F.greatest(low, F.least(_c(end), F.length(text)))
    return F.substring(text, low + 1, high - low)


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\p{Z}\s]+|[\p{Z}\s]+$", "")


def lines(text: Column) -> Column:
    parts = F.split(text, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def keys(record: Column) -> Column:
    return F.array_sort(F.map_keys(record))


def entries(record: Column) -> Column:
    return F.array_sort(F.map_entries(record))


def values(record: Column) -> Column:
    return F.transform(entries(record), lambda e: e["value"])


def range_(start: Column, end: Column) -> Column:
    low, high = _c(start).cast("long"), _c(end).cast("long")
    made = F.when(high <= low, F.array().cast("array<bigint>")).otherwise(F.sequence(low, F.greatest(low, high - 1)))
    return guarded(high - low <= BOUND, made, "BOUND_EXCEEDED", f"range span over {BOUND}")


def fold(f: Fn, start: Column, xs: Column) -> Column:
    return F.aggregate(xs, _c(start), lambda a, x: f(a, x))


def fold_right(f: Fn, start: Column, xs: Column) -> Column:
    return F.aggregate(F.reverse(xs), _c(start), lambda a, x: f(x, a))


def total_order(x: Column, *more: Column) -> Column:
    """A key that puts JSON values (variants) of any types in one order: null, bool, number, string, array, object; then more.

    Arrays and objects go by their JSON text. The type is worked out once, and only casts of that type are made."""

    def rank(kind: Column) -> Column:
        number = kind.isin("BIGINT", "DOUBLE") | F.startswith(kind, F.lit("DECIMAL"))
        return F.when(kind == "VOID", 0).when(kind == "BOOLEAN", 1).when(number, 2).when(kind == "STRING", 3).when(F.startswith(kind, F.lit("ARRAY")), 4).otherwise(5)

    def key(r: Column) -> Column:
        number, text = F.try_variant_get(x, "$", "double"), F.try_variant_get(x, "$", "string")
        return F.struct(r.alias("rank"), F.when(r == 2, number).alias("number"), F.when(r == 3, text).when(r != 2, F.to_json(x)).alias("text"), *more)

    return bound(bound(F.schema_of_variant(x), rank), key)


def sort_any(xs: Column) -> Column:
    """An array of variants in the total order, equal ones as they came."""
    return _sorted_rows(total_order, xs)


def distinct_in_order(xs: Column) -> Column:
    """Without repeats; the first of each stays in place."""
    return F.array_distinct(xs)


#: The names and numbers of arguments; name -> (arity, function), data last.
BUILTINS: dict[str, tuple[int, Fn]] = {
    "map": (2, map_), "fmap": (2, map_), "filter": (2, filter_), "zip": (2, zip_), "zipWith": (3, zip_with), "length": (1, length), "sum": (1, sum_),
    "all": (2, all_), "any": (2, any_), "min": (2, min_), "max": (2, max_), "abs": (1, F.abs), "clamp": (3, clamp), "concat": (1, concat),
    "toString": (1, to_string), "joinWith": (2, join_with), "toJson": (1, to_json), "fromJson": (2, from_json), "reverse": (1, F.reverse),
    "sort": (1, lambda xs: F.sort_array(xs)), "sortBy": (2, sort_by), "take": (2, take), "drop": (2, drop), "enumerate": (1, enumerate_),
    "mapIndexed": (2, map_indexed), "find": (2, find), "findIndex": (2, find_index), "contains": (2, contains), "indexOf": (2, index_of),
    "count": (2, count), "split": (2, split), "replace": (3, replace), "substring": (3, substring), "trim": (1, trim), "toLower": (1, F.lower),
    "toUpper": (1, F.upper), "startsWith": (2, lambda p, s: F.startswith(s, _c(p))), "endsWith": (2, lambda p, s: F.endswith(s, _c(p))),
    "strLength": (1, lambda s: F.length(s).cast("long")), "lines": (1, lines), "unlines": (1, lambda xs: F.array_join(xs, "\n")), "keys": (1, keys),
    "values": (1, values), "entries": (1, entries), "withDefault": (2, lambda d, x: F.coalesce(x, _c(d))), "isNull": (1, F.isnull), "range": (2, range_),
    "fold": (3, fold), "foldRight": (3, fold_right),
}


class Builtin:
    """A function with the arguments it has so far; it runs once it has all of them."""

    def __init__(self, name: str, given: tuple = ()):
        if name not in BUILTINS:
            raise ExpressionError("MISSING_VARIABLE", name)
        self.name, self.given = name, given

    def __call__(self, *more):
        arity, run = BUILTINS[self.name]
        args = (*self.given, *more)
        if len(args) > arity:
            raise ExpressionError("ARITY", f"{self.name} takes {arity}")
        return run(*args) if len(args) == arity else Builtin(self.name, args)


@functools.cache
def environment() -> dict[str, Builtin]:
    return {name: Builtin(name) for name in BUILTINS}
