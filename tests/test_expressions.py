from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dagframe.functions import builtins as B
from dagframe.functions.errors import ExpressionError
from dagframe.functions.expression import If, Lambda, ListOf, Literal, Record, Text, Unary, Var, bound_inputs, compiled, divided, fn, joined_settings, let, merged_settings, node, op, projection, record, value


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_environment_is_closed():
    assert len(B.BUILTINS) == 49
    assert {n: a for n, (a, _) in B.BUILTINS.items()}["foldRight"] == 3


@pytest.mark.parametrize(
    ("column", "expected"),
    [
        (lambda: F.reverse(F.array(*map(F.lit, (1, 2, 3)))), [3, 2, 1]),
        (lambda: B.take(9, F.array(*map(F.lit, (1, 2, 3)))), [1, 2, 3]),
        (lambda: B.drop(5, F.array(*map(F.lit, (1, 2, 3)))), []),
        (lambda: B.take(-1, F.array(*map(F.lit, (1, 2, 3)))), []),
        (lambda: B.find(lambda x: x > 1, F.array(*map(F.lit, (0, 2, 3)))), 2),
        (lambda: B.find(lambda x: x > 1, F.array(*map(F.lit, (0, 1)))), None),
        (lambda: B.find_index(lambda x: x > 1, F.array(*map(F.lit, (0, 2, 3)))), 1),
        (lambda: B.find_index(lambda x: x > 1, F.array(*map(F.lit, (0, 1)))), -1),
        (lambda: B.count(lambda x: x > 1, F.array(*map(F.lit, (0, 2, 3)))), 2),
        (lambda: B.replace("na", "-", F.lit("nanogram")), "-nogram"),
        (lambda: B.replace("", "x", F.lit("ab")), "ab"),
        (lambda: B.substring(F.lit(1), F.lit(3), F.lit("hello")), "el"),
        (lambda: B.substring(F.lit(4), F.lit(2), F.lit("hello")), ""),
        (lambda: B.trim(F.lit("  hi 　")), "hi"),
        (lambda: F.length(F.lit("héllo")), 5),
        (lambda: B.split(",", F.lit("a,b,c")), ["a", "b", "c"]),
        (lambda: B.split("", F.lit("")), []),
        (lambda: B.split(".", F.lit("a.b")), ["a", "b"]),
        (lambda: B.lines(F.lit("a\nb\n")), ["a", "b"]),
        (lambda: B.lines(F.lit("")), []),
        (lambda: B.keys(F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1))), ["a", "b"]),
        (lambda: B.values(F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1))), [1, 2]),
        (lambda: B.range_(2, 5), [2, 3, 4]),
        (lambda: B.range_(5, 2), []),
        (lambda: B.fold(lambda a, x: a + x, F.lit(0), F.array(*map(F.lit, (1, 2, 3)))), 6),
        (lambda: B.fold_right(lambda x, a: x - a, F.lit(0), F.array(*map(F.lit, (1, 2, 3)))), 2),
        (lambda: F.size(B.zip_(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3)))), 1),
        (lambda: B.clamp(F.lit(5), F.lit(1), F.lit(3)), 5),
        (lambda: B.sum_(F.array().cast("array<decimal(10,2)>")), Decimal(0)),
        (lambda: B.all_(lambda x: x > 0, F.array().cast("array<int>")), True),
        (lambda: B.any_(lambda x: x > 0, F.array().cast("array<int>")), False),
        (lambda: B.number_text(F.lit(Decimal("1.500"))), "1.5"),
        (lambda: B.number_text(F.lit(Decimal("100"))), "100"),
        (lambda: B.sort_by(lambda x: x % 2, F.array(*map(F.lit, (3, 2, 1, 4)))), [2, 4, 3, 1]),
        (lambda: F.upper(F.lit("straße")), "STRASSE"),
        (lambda: B.contains(F.lit(None).cast("int"), F.array(F.lit(1), F.lit(None).cast("int"))), True),
    ],
)
def test_builtins(spark, column, expected):
    assert one(spark, column()) == expected


@pytest.mark.parametrize(("column", "code"), [(lambda: divided(F.lit(1), F.lit(0)), "DIVISION_BY_ZERO"), (lambda: B.range_(0, 1_000_001), "BOUND_EXCEEDED"), (lambda: value(compiled(node([1])[3], {})), "INDEX_OUT_OF_BOUNDS")])
def test_rows_fail_with_their_code(spark, column, code):
    with pytest.raises(Exception, match=code):
        one(spark, column())


def _variants(text):
    return F.variant_get(F.parse_json(text), "$", "array<variant>")


def test_arrays_of_all_types_in_one_order(spark):
    def sorted_(text):
        return one(spark, F.to_json(B.sort_any(_variants(F.lit(text)))))

    assert sorted_('[{"k":1},[1],"a",7,true,null,false,[],"",1.5,null]') == '[null,null,false,true,1.5,7,"","a",[1],[],{"k":1}]'
    assert sorted_("[0,-1,2,1e0,1,1e0]") == "[-1,0,1.0,1,1.0,2]"
    assert sorted_('["z","a!","a b","a","t"]') == '["a","a b","a!","t","z"]'
    assert sorted_("[]") == "[]"


def test_sort_works_out_its_input_once_a_row(spark):
    """Made anew for an element, other random numbers would come than those that were sorted."""
    xs = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.hash(F.uuid(), k))
    rows = spark.range(3).select(B.sort_by(lambda x: x, xs).alias("x")).collect()
    assert [r["x"] for r in rows] == [sorted(r["x"]) for r in rows]


def test_total_order_works_out_a_type_once_an_element(spark):
    plan = spark.range(1).select(B.sort_any(_variants(F.col("id").cast("string"))).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1 and plan.count("schemaOfVariant(") == 1


def test_fold_over_text(spark):
    step = fn("text", "k", body=Text((Var("text"), Literal(";"), op("-", Literal(10), Var("k")))))
    assert one(spark, value(compiled(Var("fold")(step, "from", Var("range")(2, 5)), {}))) == "from;8;7;6"


def test_sums_keep_small_digits(spark):
    assert one(spark, B.sum_(F.array(F.lit(Decimal("0.00000004")), F.lit(Decimal("0.00000004"))))) == Decimal("0.00000008")


def test_take_refuses_parts(spark):
    with pytest.raises(Exception, match="TYPE_MISMATCH"):
        one(spark, B.take(F.lit(1.5), F.array(F.lit(1))))


def test_bound_inputs_and_settings():
    ports = {"left": "A", "right": "A", "other": "B"}
    assert bound_inputs(ports, [("left", "A", 1), ("right", "A", 2), (None, "B", 3)]) == {"left": 1, "right": 2, "other": 3}
    assert bound_inputs({"": "A"}, [(None, "A", 7)]) == {"in": 7}
    for given, code in (([(None, "A", 1)], "INPUT_NOT_CLEAR"), ([("up", "A", 1)], "INPUT_UNKNOWN"), ([("left", "B", 1)], "INPUT_CONTRACT"), ([("left", "A", 1)], "INPUT_LACKING")):
        with pytest.raises(ExpressionError, match=code):
            bound_inputs(ports, given)
    assert merged_settings({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}, "c": 4}) == {"a": {"x": 1, "y": 3}, "b": 1, "c": 4}
    assert joined_settings("ab", "c") == "abc" and joined_settings([1], [2]) == [1, 2]
    with pytest.raises(ExpressionError, match="TYPE_MISMATCH"):
        joined_settings("a", [1])


def test_records_merge_and_nest(spark):
    merged = op("//", Record((("a.b", Literal(1)), ("a.c", Literal(2)))), Record((("a.b", Literal(3)), ("d", Literal(4)))))
    assert one(spark, value(compiled(merged, {}))).asDict(True) == {"a": {"b": 3, "c": 2}, "d": 4}
    with pytest.raises(ExpressionError, match="DUPLICATE_PATH"):
        compiled(Record((("a", Literal(1)), ("a.b", Literal(2)))), {})


def test_static_errors():
    for bad, code in ((Var("nope"), "MISSING_VARIABLE"), (record(a=1).b, "FIELD_MISSING"), (Literal(1)(2), "FUNCTION_EXPECTED"), (Var("abs")(1, 2), "ARITY")):
        with pytest.raises(ExpressionError, match=code):
            compiled(bad, {})
    with pytest.raises(ExpressionError, match="DUPLICATE_PARAMETER"):
        fn("x", "x", body=Var("x"))


def test_short_circuit_and_partial_application(spark):
    safe = op("||", Literal(True), op(">", op("/", Literal(1), Literal(0)), 1))
    assert one(spark, value(compiled(safe, {}))) is True
    add = Lambda(("x", "y"), op("+", Var("x"), Var("y")))
    assert one(spark, value(compiled(let(Var("inc")(4), inc=add(1)), {}))) == 5
    assert one(spark, value(compiled(If(Unary("!", Literal(False)), Literal("a"), Literal("b")), {}))) == "a"
    assert one(spark, value(compiled(ListOf((Literal(1), Literal(2))).pipe(Var("length")), {}))) == 2


def test_projection_of_a_frame(spark):
    df = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int")
    run = projection({"s": op("+", Var("a"), Var("c"))}, lets={"c": op("*", Var("b"), 2)}, where=record(a=op("-", Var("a"), 1)))
    assert [r.s for r in run(df).collect()] == [4, 10]
