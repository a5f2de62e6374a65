"""Expressions against hand-computed values."""

import pytest
from pyspark.sql import functions as F

from silvaflow.functions import classes as C
from silvaflow.functions import scalars as S
from silvaflow.functions import spectral as P


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_beams(spark):
    rows = [(1, "gt1r"), (1, "gt1l"), (0, "gt2r"), (0, "gt2l"), (2, "gt1l")]
    assert values(spark, rows, "o int, g string", S.beam_strength(F.col("o"), F.col("g"))) == [("Strong",), ("Weak",), ("Weak",), ("Strong",), (None,)]
    assert values(spark, [(1,), (2,), (7,), (0,)], "s int", S.spot_strength(F.col("s"))) == [("strong",), ("weak",), (None,), (None,)]


def test_dates_and_names(spark):
    parts = S.date_parts(F.lit("b'2019-08-02 10:00:00'"))
    assert [one(spark, c) for c in parts.values()] == [2019, 8, 2, 214]
    assert one(spark, S.name_token(F.lit("boreal_agb_0123.tif"), 2, "*.tif")) == "0123"
    assert one(spark, S.last_token_number(F.lit("tile_0042.tif"))) == 42
    assert one(spark, S.run_type(F.lit("40"), F.lit("06-01"), F.lit(None).cast("string"), F.lit("2020"))) == "40_06-01_2020"
    assert one(spark, S.month_end(F.lit("2020-02-10").cast("date"))) == 29
    assert one(spark, S.clean_label(F.lit("Young Forest."))) == "young_forest"
    assert [one(spark, S.truth(F.lit(t))) for t in ("t", "true", "no")] == [True, True, False]
    assert S.class_ranges("0-10:young,11-20:old") == [(0, 10, "young"), (11, 20, "old")]
    assert one(spark, S.truncated(F.lit(-1.23456), 2)) == pytest.approx(-1.23)
    assert one(spark, S.decimal_year(F.lit(1900), F.lit(10), 1984, 2030)) is None


def test_numbers(spark):
    assert values(spark, [("1.5",), ("x",), (None,)], "t string", S.number(F.col("t"))) == [(1.5,), (None,), (None,)]
    assert one(spark, S.stock_pg(F.lit(100.0))) == pytest.approx(9e-9)
    assert one(spark, S.canopy_cover(F.lit(1), F.lit(1), F.lit(2))) == 0.5
    assert one(spark, S.canopy_cover(F.lit(0), F.lit(0), F.lit(0))) is None
    assert one(spark, S.labelled(F.lit(9), S.SNOW)) is None


PIXEL = dict(zip(P.BANDS, (0.04, 0.06, 0.05, 0.30, 0.15, 0.08)))
def bands():
    return {k: F.lit(v) for k, v in PIXEL.items()}


def test_indices(spark):
    want = {"ndvi": 0.7142857, "ndsi": -0.4285714, "savi": 0.4411765, "msavi": 0.4258343, "ndmi": 0.3333333, "evi": 0.4807692, "evi2": 0.4401408, "nbr": 0.5789474, "nbr2": 0.3043478}
    for name, c in P.indices(bands()).items():
        assert one(spark, c) == pytest.approx(want[name], abs=1e-6)


def test_tasselled_cap(spark):
    five = [one(spark, c) for c in P.tasselled_cap(bands()).values()]
    six = [one(spark, c) for c in P.tasselled_cap(bands(), 6).values()]
    assert five == pytest.approx([0.27983, 0.224002, -0.025374], abs=1e-5)
    assert six == pytest.approx([0.298254, 0.212434, -0.074246], abs=1e-5)


def test_quality_bits(spark):
    got = values(spark, [(2,), (8,), (192,), (64,), (1,), (32,)], "q int", P.qa_masked(F.col("q")))
    assert [g[0] for g in got] == [True, True, True, False, False, True]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (C.age_class, [0, 0.5, 20, 20.1, 36, 60, 80, 100, 150, 151], [0, 1, 1, 2, 2, 3, 4, 5, 6, 7]),
        (C.age_cohort, [0, 1, 20, 20.5, 21, 200, 201, 202, None], [0, 1, 1, -1, 2, 3, -1, 4, -1]),
        (C.canopy_trend, [-3, -2, -0.5, 0, 0.5, 0.6, 2, 2.1, None, 255], [0, 1, 2, 2, 2, 3, 3, 4, 5, 5]),
        (C.simple_trend, list(range(11)), [-1, 4, 4, 3, 3, 2, 2, 1, 1, 0, 0]),
        (C.significance, [0.01, 0.05, None], [1, 0, 2]),
    ],
)
def test_ladders(spark, f, given, want):
    kind = "int" if f is C.simple_trend else "double"
    rows = [(None if g is None else (int(g) if kind == "int" else float(g)),) for g in given]
    assert [r[0] for r in values(spark, rows, f"x {kind}", f(F.col("x")))] == want


def test_kendall_classes(spark):
    rows = [(0.73, 0.04), (0.73, 0.06), (-0.3, 0.01), (0.0, 0.01), (-0.7, 0.01), (0.2, 0.01)]
    assert [r[0] for r in values(spark, rows, "t double, p double", C.kendall_class(F.col("t"), F.col("p")))] == [1, 5, 8, 5, 10, 3]


def test_age_fill(spark):
    rows = [(None, 30), (0, 50), (0, 40), (12, 50)]
    assert [r[0] for r in values(spark, rows, "a int, b int", C.filled_age(F.col("a"), F.col("b")))] == [30, 100, 0, 12]
