"""Expressions as text mean what the same Columns mean."""

import random

import pytest
from pyspark.sql import functions as S

from xsdframe.functions.sql import Expr, F, let, text_of

ROWS = [(1, "a'b", True, [1, 2, 3]), (-7, "x\\y\n", False, []), (None, None, None, None), (3, "", True, [None, 5])]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "n int, s string, b boolean, xs array<int>").coalesce(1)


def trees(m, col, depth, rnd):
    """A random boolean expression, with the functions of m over the columns that col gives."""
    if not depth:
        kind = rnd.randrange(6)
        return [
            lambda: col("n") + 2 * col("n") - 1 > rnd.randrange(5), lambda: col("b"), lambda: col("s") == "a'b", lambda: col("s").isNull(),
            lambda: m.coalesce(m.length(col("s")), m.lit(0)) % 2 == 0, lambda: -(col("n") - 3) <= col("n") / 2,
        ][kind]()
    left, right = (trees(m, col, depth - 1, rnd) for _ in range(2))
    kind = rnd.randrange(6)
    return [
        lambda: left & right, lambda: left | right, lambda: ~left, lambda: m.coalesce(left, m.lit(False)) == right,
        lambda: m.when(left, right).otherwise(m.lit(False)), lambda: (left | right) & ~(left & right),
    ][kind]()


def test_random_expressions(df):
    for seed in range(60):
        text = trees(F, F.col, 3, random.Random(seed))
        column = trees(S, S.col, 3, random.Random(seed))
        assert isinstance(text, Expr) and not isinstance(column, Expr)
        rows = df.select(text.alias("t"), column.alias("c")).collect()
        assert [r.t for r in rows] == [r.c for r in rows], text


def test_literals_and_fields(df):
    odd = ["it's", "back\\slash", "line\nend\r\t", "%_", "é😀", "\0x"]
    row = df.select(*(F.lit(x).alias(f"v{k}") for k, x in enumerate(odd)), F.lit(1 << 40).alias("n"), F.lit(-0.5).alias("f"), F.lit(float("inf")).alias("i"), F.lit(None).alias("z")).first()
    assert list(row)[: len(odd)] == odd and (row.n, row.f, row.i, row.z) == (1 << 40, -0.5, float("inf"), None)
    with pytest.raises(TypeError):
        text_of(object())
    with pytest.raises(ValueError):
        bool(F.lit(1) == 2)
    made = F.struct(F.lit(5).alias("odd `name"), F.when(F.col("b"), F.struct(F.col("n").alias("@in"))).alias("s"))
    got = df.select(made["odd `name"].alias("a"), made["s"]["@in"].alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(5, 1), (5, None), (5, None), (5, 3)]


def test_lambdas_concat_and_let(df):
    plus = F.transform(F.col("xs"), lambda x, i: x + i)
    kept = F.filter(plus, lambda x: x.isNotNull() & (x > 1))
    twice = let(F.concat(F.col("s"), F.lit("-"), F.concat(F.lit("-"), F.col("s"))), lambda v: F.concat(v, F.lit("|"), v))
    once = let(F.length(F.col("s")) + 1, lambda v: v * 2)
    assert "->" not in once.text and twice.text.count("'--'") == 1
    got = df.select(kept.alias("k"), twice.alias("t"), once.alias("o"), F.forall(F.col("xs"), lambda x: x < 9).alias("a")).collect()
    assert [r.k for r in got] == [[3, 5], [], None, [6]]
    assert got[0].t == "a'b--a'b|a'b--a'b" and [r.o for r in got] == [8, 10, None, 2] and got[0].a is True


def test_columns_take_the_ordinary_functions(df):
    """Given a Column, functions give Columns, mixed with texts as need be."""
    mixed = F.coalesce(S.col("n"), F.lit(0)) + F.lit(1)
    chosen = F.when(S.col("b"), F.lit("yes")).otherwise(F.lit("no"))
    got = df.select(mixed.alias("m"), chosen.alias("c"), (F.col("n") == S.col("n")).alias("e"), let(S.col("n"), lambda v: v * v).alias("q")).collect()
    assert [(r.m, r.c, r.e, r.q) for r in got] == [(2, "yes", True, 1), (-6, "no", True, 49), (1, "no", None, None), (4, "yes", True, 9)]
