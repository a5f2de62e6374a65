"""Class ladders of age, trend and significance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds (inclusive) of age classes 1 to 6; above is 7, nothing or 0 is 0.
AGE_UPPER = (20, 36, 60, 80, 100, 150)
#: Age cohorts as inclusive ranges, and the age above which growth is old.
COHORTS, OLD_ABOVE = ((0, 0), (1, 20), (21, 80), (81, 200)), 201
#: Strengths of Kendall's tau.
STRENGTHS = (0.7, 0.4, 0.2)
#: The eleven trend classes as five (and none).
SIMPLE_TREND = {0: -1, 1: 4, 2: 4, 3: 3, 4: 3, 5: 2, 6: 2, 7: 1, 8: 1, 9: 0, 10: 0}


def age_class(age: Column) -> Column:
    out = F.when(age.isNull() | (age <= 0), 0)
    for k, upper in enumerate(AGE_UPPER, 1):
        out = out.when(age <= upper, k)
    return out.otherwise(len(AGE_UPPER) + 1)


def age_cohort(age: Column) -> Column:
    """0 to 4; ages between the inclusive ranges, and nulls, give -1."""
    out = F.when(age.isNull(), -1)
    for k, (low, high) in enumerate(COHORTS):
        out = out.when(age.between(low, high), k)
    return out.when(age > OLD_ABOVE, len(COHORTS)).otherwise(-1)


def canopy_trend(slope: Column) -> Column:
    """0 strong decline to 4 strong growth; 5 unknown (null or 255)."""
    return F.when(slope.isNull() | (slope == 255), 5).when(slope < -2, 0).when(slope < -0.5, 1).when(slope <= 0.5, 2).when(slope <= 2, 3).otherwise(4)


def significance(p: Column, alpha: float = 0.05) -> Column:
    return F.when(p.isNull(), 2).when(p < alpha, 1).otherwise(0)


def deciduous(share: Column) -> Column:
    return F.when(share.isNull(), F.lit(None).cast("int")).when(share < 33, 0).when(share <= 66, 1).otherwise(2)


def forest_stage(age: Column) -> Column:
    return F.when(age <= 0, 0).when(age <= 36, 1).when(age <= 100, 2).when(age <= 150, 3).when(age > 150, 4)


def kendall_class(tau: Column, p: Column, alpha: float = 0.05) -> Column:
    """1 to 4: rising, strong to very weak; 5 no significant trend; 7 to 10: falling, very weak to strong."""
    sure = p < alpha
    out = F.when(tau.isNull() | p.isNull(), 0)
    for k, s in enumerate(STRENGTHS, 1):
        out = out.when(sure & (tau >= s), k)
    out = out.when(sure & (tau > 0), 4)
    for k, s in enumerate(STRENGTHS):
        out = out.when(sure & (tau <= -s), 10 - k)
    return out.when(sure & (tau < 0), 7).otherwise(5)


def simple_trend(kendall: Column) -> Column:
    pairs = [F.lit(x) for kv in SIMPLE_TREND.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), kendall)


#: Labels and colours (red, green, blue, opacity) of the eleven trend classes.
KENDALL = {
    0: ("No data", (255, 255, 255, 0)),
    1: ("Strong sig. positive", (0, 0, 204, 255)),
    2: ("Moderate sig. positive", (51, 51, 255, 255)),
    3: ("Weak sig. positive", (102, 102, 255, 255)),
    4: ("Very weak sig. positive", (153, 153, 255, 255)),
    5: ("Non-sig. positive", (204, 204, 204, 255)),
    6: ("Non-sig. negative", (153, 153, 153, 255)),
    7: ("Very weak sig. negative", (255, 153, 153, 255)),
    8: ("Weak sig. negative", (255, 102, 102, 255)),
    9: ("Moderate sig. negative", (255, 51, 51, 255)),
    10: ("Strong sig. negative", (204, 0, 0, 255)),
}
#: Labels of age cohorts and of the simplified trends, in their order.
COHORT_LABELS = {0: "non-forest", 1: "young", 2: "maturing", 3: "mature", 4: "old-growth"}
TREND_LABELS = {0: "strong_decline", 1: "moderate_decline", 2: "stable", 3: "moderate_increase", 4: "strong_increase"}


def kendall_legend(spark):
    """kendall, label, red, green, blue, alpha: the dimension that goes with a raster of classes."""
    return spark.createDataFrame([(k, label, *colour) for k, (label, colour) in KENDALL.items()], "kendall int, label string, red int, green int, blue int, alpha int")


def cohort_label(cohort: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in COHORT_LABELS.items() for x in kv]), cohort)


def trend_label(trend: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in TREND_LABELS.items() for x in kv]), trend)


def filled_age(age: Column, alternative: Column) -> Column:
    """Age, or where it is missing or 0 the other source: young as it is, 50 as 100."""
    missing = age.isNull() | (age == 0)
    return F.when(missing & (alternative > 0) & (alternative <= 36), alternative).when(missing & (alternative == 50), F.lit(100)).otherwise(age)


def suggested_alpha(n: int) -> float:
    """A looser level for shorter series."""
    return 0.1 if n < 10 else 0.05 if n < 30 else 0.01
