"""Line dedup by an exact set-similarity join, with DataFrame operations alone.

A line's tokens are its distinct runs of five words (in lower case); a line of one to four words has one, its whole sequence, so
that it matches its like alone, and a line without words has none and always stays. Two lines match if the Jaccard similarity of their tokens is at least 3/4. A line goes if a line before it, in the order of ids
and then of lines, matches it; documents keep their other lines as they are.

Lines with equal tokens are one class, reduced before anything is shuffled by token. Tokens are ordered by rarity (counted
over all lines in a table of fixed size, which only sets the order); classes that match share a token of their prefixes.
Prefix tokens of one class alone are dropped, by a combinable count and a bit filter of fixed size. Candidates pass
a length and a positional filter, are verified on their whole token sets, and the later one's class goes. Every list first asks
its earliest class only, which settles groups of variants in as many comparisons as members; classes that are still in
are then compared with all earlier ones of their lists.

Defined results: ids are integers (others fail); a null text has no lines and stays null; empty and blank lines stay; rows that share an id share its place in the
order, so that none of their lines is later than its like in the other, and lose their own lines only; a null id comes first; a text that loses all its lines becomes
empty; no rows give no rows; extra columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dagframe.llm.shared import released, stored

SIZE = 5
#: Slots of the rarity table, and bounds of the filters' bits; collisions cost time and never a match.
SLOT_BITS, LEAST_FILTER_BITS, MOST_FILTER_BITS = 16, 20, 26
#: White space of a line besides the blank.
SPACES = "\t\x0b\x0c\r"


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is worked out once a row: no optimizer rule moves its expression through a generator, as rules for
    projections do, which would split a line again for each of its words."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def _worded(docs: DataFrame, text: Column, doc: Column) -> DataFrame:
    """Lines that have words: by the id, the text's hash (which tells rows of one id apart) and their number, `words` as hashes."""
    odd = F.lit(False)
    for c in SPACES:
        odd = odd | F.contains(text, F.lit(c))
    plain = F.lower(F.when(odd, F.translate(text, SPACES, " " * len(SPACES))).otherwise(text))
    lines = _once(docs, "h", F.xxhash64(text)).select(doc.alias("doc"), "h", F.posexplode_outer(F.split(plain, "\n", -1)).alias("at", "line"))
    return _once(lines, "words", F.expr("transform(filter(split(line, ' '), w -> w <> ''), w -> xxhash64(w))")).drop("line").where(F.size("words") > 0)


#: Numbers of a line's runs of words, and the hash of run `i`; a line of fewer words has one, its whole sequence.
_RUNS = f"sequence(0, greatest(size(words) - {SIZE}, 0))"
_RUN = f"xxhash64({', '.join(f'get(words, i + {k})' for k in range(SIZE))})"


def _bits(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """One row: an array of bits in longs, those of the keys' hashes set; and the exponent of their number, which follows the keys'."""
    bits = min(MOST_FILTER_BITS, max(LEAST_FILTER_BITS, (32 * keys.count()).bit_length()))
    slot = F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
    words = keys.select(F.shiftright(slot, 6).alias("word"), slot.alias("slot"))
    words = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    every = keys.sparkSession.range(0, 1 << (bits - 6), 1, 1).select(F.col("id").alias("word"))
    packed = stored(words, "bits")  # 2**MOST_FILTER_BITS / 64 rows at most
    held = every.join(F.broadcast(packed), "word", "left").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda x: x["bits"]).alias("bits"))
    return stored(held, "filter"), bits


def _set(filter_: tuple[DataFrame, int], key: Column) -> Column:
    held, bits = filter_
    slot = F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
    word = F.get(held.scalar(), F.shiftright(slot, 6).cast("int"))
    return F.call_function("shiftright", word, slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _enough(x: str, y: str) -> str:
    return f"4 * {x} >= 3 * {y} and 4 * {y} >= 3 * {x}"


def _shares(m: str, c: str, n: str, d: str) -> str:
    """Sets of m and n tokens, of which prefixes c and d are shared with any set, share at most the fewer of these and what stands behind
    the longer prefix."""
    return f"7 * (least({c}, {d}) + cast(ceil(3 * greatest({m}, {n}) / 4) as int) - 1) >= 3 * ({m} + {n})"


def _rarity(worded: DataFrame) -> DataFrame:
    """One row: for each slot of the tokens' hashes, eighths of the logarithm of how often its tokens occur, over the least slot's."""
    spark = worded.sparkSession
    # counted row by row, which Spark compiles, as no line's tokens must come together
    every = worded.select("words", F.explode_outer(F.expr(_RUNS)).alias("i")).select(F.expr(_RUN).alias("t"))
    counts = stored(every.groupBy(F.expr(f"cast(shiftrightunsigned(t, {64 - SLOT_BITS}) as int)").alias("slot")).agg(F.count("*").alias("n")), "rarity")  # 2**SLOT_BITS rows at most
    slots = spark.range(0, 1 << SLOT_BITS, 1, 1).select(F.col("id").cast("int").alias("slot"))
    held = slots.join(F.broadcast(counts), "slot", "left").agg(F.array_sort(F.collect_list(F.struct("slot", (F.coalesce("n", F.lit(0)) + 1).alias("n")))).alias("s"), F.min(F.coalesce("n", F.lit(0)) + 1).alias("least"))
    out = stored(held.select(F.expr("transform(s, x -> cast(least(127, floor(8 * log2(x.n / least))) as tinyint))").alias("r")), "rarity-array")
    released(counts)
    return out


def _matches(pairs: DataFrame, places: DataFrame, docs: DataFrame, text: Column, doc: Column) -> DataFrame:
    """Of stored pairs (a, b) of classes, the b of those that match. Token sets are made again for these classes' first lines only."""
    needed = stored(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(places, "cls").select("cls", "doc", "h", "at"), "needed")
    some = _bits(needed.select("doc").distinct(), "doc")
    lines = _worded(docs.where(_set(some, doc)), text, doc).join(needed, ["doc", "h", "at"])
    sets = stored(lines.dropDuplicates(["cls"]).select("cls", F.expr(f"array_distinct(transform({_RUNS}, i -> {_RUN}))").alias("tokens")), "line-sets")
    x, y = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("cls").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("b", F.size("x").alias("m"), F.size("y").alias("n"), F.size(F.array_intersect("x", "y")).alias("same"))
    out = stored(both.where("100 * same >= 75 * (m + n - same)").select(F.col("b").alias("cls")).distinct(), "gone")
    released(needed, some[0], sets)
    return out


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, h, gone): of each id (a null one is the least long) and hash of a text that loses lines, their numbers from 0."""
    doc, text = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), F.col(text_col)
    given = docs.select(id_col, text_col)
    worded = _worded(given, text, doc)
    rare = _rarity(worded)

    # One projection: the table of rarity is a value of the plan and travels with no row.
    sets = worded.select("doc", "h", "at", F.expr(f"array_distinct(transform({_RUNS}, i -> {_RUN}))").alias("tokens")).withColumn("rare", rare.scalar())
    class_of = f"cast(get(rare, cast(shiftrightunsigned(t, {64 - SLOT_BITS}) as int)) as bigint)"
    ordered = sets.select("doc", "h", "at", F.expr(f"sort_array(transform(tokens, t -> shiftleft({class_of}, 56) | (t & 72057594037927935L)))").alias("tokens"))
    ordered = ordered.select("doc", "h", "at", F.size("tokens").alias("n"), F.xxhash64("tokens").alias("cls"), F.expr("slice(tokens, 1, size(tokens) - cast(ceil(3 * size(tokens) / 4) as int) + 1)").alias("prefix"))
    ordered = stored(ordered, "lines")
    # One row a class: the earliest line, and the prefix, which is the same in all.
    classes = stored(ordered.groupBy("cls").agg(F.min(F.struct("doc", "at", "h")).alias("first"), F.count("*").alias("lines"), F.first("n").alias("n"), F.first("prefix").alias("prefix")), "classes")
    known = stored(ordered.select("cls", "doc", "h", "at"), "line-classes")
    released(ordered, rare)
    entry = classes.select("cls", F.struct("first.doc", "first.at").alias("first"), "n", F.posexplode("prefix").alias("place", "token"))
    shared = stored(entry.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token"), "tokens")
    some, bits = _bits(shared, "token")
    # Shared tokens only (and few others that the filter lets through), with how many of them the class has; a value of the plan, as the rarity is.
    slot = f"shiftrightunsigned(xxhash64(e.token), {64 - bits})"
    there = f"shiftright(get(bits, cast(shiftright({slot}, 6) as int)), cast({slot} & 63 as int)) & 1 = 1"
    held = classes.select("cls", F.struct("first.doc", "first.at").alias("first"), "n", "prefix").withColumn("bits", some.scalar())
    held = held.select("cls", "first", "n", F.expr(f"filter(transform(prefix, (t, i) -> struct(i as place, t as token)), e -> {there})").alias("held"))
    entries = stored(held.select("cls", "first", "n", F.size("held").alias("c"), F.inline("held")), "entries")
    released(shared, some)
    places = classes.select("cls", "first.doc", "first.h", "first.at")

    lead = entries.groupBy("token").agg(F.min(F.struct("first", "cls", "n", "c")).alias("lead")).select("token", F.col("lead.cls").alias("a"), F.col("lead.n").alias("m"), F.col("lead.first").alias("led"), F.col("lead.c").alias("d"))
    star = stored(entries.join(lead, "token").where("led < first").where(_enough("n", "m")).where(_shares("n", "c", "m", "d")).select("a", F.col("cls").alias("b")).distinct(), "star")
    gone = _matches(star, places, given, text, doc)
    later = entries.join(gone, "cls", "left_anti").alias("y")
    least = "least(x.n - x.place, y.n - y.place)"
    rest = entries.alias("x").join(later, F.expr(f"x.token = y.token and x.first < y.first and {_enough('x.n', 'y.n')} and 7 * {least} >= 3 * (x.n + y.n) and {_shares('x.n', 'x.c', 'y.n', 'y.c')}"))
    rest = stored(rest.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct().join(star, ["a", "b"], "left_anti"), "rest")
    gone = gone.unionAll(_matches(rest, places, given, text, doc)).distinct()

    # All lines of classes that go, and the later lines of classes that stay.
    state = classes.join(gone.withColumn("goes", F.lit(True)), "cls", "left").where("lines > 1 or goes").select("cls", "first", F.coalesce("goes", F.lit(False)).alias("goes"))
    state = stored(state, "state")
    some = _bits(state, "cls")
    lost = known.where(_set(some, F.col("cls"))).join(state, "cls").where(F.expr("goes or struct(doc, at) > struct(first.doc, first.at)"))
    out = stored(lost.groupBy("doc", "h").agg(F.collect_set("at").alias("gone")), "lost")
    released(classes, known, entries, star, rest, state, some[0])
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The documents without the lines that go; with count_col, also how many went."""
    lost = removals(docs, id_col, text_col)
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    row = row.withColumn("doc", F.coalesce(F.col("row")[id_col].cast("long"), F.lit(-(1 << 63)))).withColumn("h", F.xxhash64(F.col("row")[text_col]))
    touched = _set(_bits(lost, "doc"), F.col("doc"))
    some = row.where(touched).join(lost, ["doc", "h"], "left").select("row", "gone")
    text = F.when(
        F.col("gone").isNotNull(),
        F.array_join(F.transform(F.filter(F.transform(F.split(F.col("row")[text_col], "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(F.col("gone"), s["i"])), lambda s: s["x"]), "\n"),
    ).otherwise(F.col("row")[text_col])
    number = F.size(F.coalesce("gone", F.array().cast("array<int>"))).cast("long")
    every = row.where(~touched).select("row", F.lit(None).cast("array<int>").alias("gone")).unionAll(some)
    kept = [text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return every.select(*kept, *([number.alias(count_col)] if count_col else []))
