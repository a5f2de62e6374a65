"""Reflectance indices and quality bits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS = ("blue", "green", "red", "nir", "swir", "swir2")
#: Tasselled cap weights of the six bands.
TASSELLED = {
    "brightness": (0.2043, 0.4158, 0.5524, 0.5741, 0.3124, 0.2303),
    "greenness": (-0.1603, 0.2819, -0.4934, 0.7940, -0.0002, -0.1446),
    "wetness": (0.0315, 0.2021, 0.3102, 0.1594, -0.6806, -0.6109),
}
#: Scale and offset of stored reflectance.
SCALES = {"HLS": (0.0001, 0.0), "LC2": (0.0000275, -0.2)}


def scaled(band: Column, product: str) -> Column:
    a, b = SCALES[product]
    return band * a + b


def difference_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def indices(b: Mapping[str, Column]) -> dict[str, Column]:
    """All indices of the six bands; a zero denominator gives null."""
    n, r, s, s2 = b["nir"], b["red"], b["swir"], b["swir2"]
    return {
        "ndvi": difference_ratio(n, r),
        "ndsi": difference_ratio(b["green"], s),
        "savi": F.try_divide(1.5 * (n - r), n + r + 0.5),
        "msavi": (2 * n + 1 - F.sqrt((2 * n + 1) * (2 * n + 1) - 8 * (n - r))) / 2,
        "ndmi": difference_ratio(n, s),
        "evi": F.try_divide(2.5 * (n - r), n + 6 * r - 7.5 * b["blue"] + 1),
        "evi2": F.try_divide(2.5 * (n - r), n + 2.4 * r + 1),
        "nbr": difference_ratio(n, s2),
        "nbr2": difference_ratio(s, s2),
    }


def tasselled_cap(b: Mapping[str, Column], bands: int = 5) -> dict[str, Column]:
    """Brightness, greenness and wetness from the first five bands, or all six."""
    return {name: sum((b[x] * w for x, w in list(zip(BANDS, weights))[1:bands]), b[BANDS[0]] * weights[0]) for name, weights in TASSELLED.items()}


def vegetated(ndvi: Column, threshold: float) -> Column:
    return F.coalesce((ndvi > threshold).cast("int"), F.lit(0))


#: Quality bits that mask a pixel: cloud, its neighbour, its shadow, snow, water; high aerosol is both of two.
QA_BITS = {"cloud": 1, "adjacent": 2, "shadow": 3, "snow": 4, "water": 5}
QA_HIGH_AEROSOL = 192


def qa_masked(qa: Column, bits: tuple[str, ...] = tuple(QA_BITS), aerosol: bool = True) -> Column:
    """Is any of the bits set, or the aerosol level high?"""
    out = F.lit(False)
    for name in bits:
        out = out | (F.getbit(qa, F.lit(QA_BITS[name])) == 1)
    return out | (qa.bitwiseAND(QA_HIGH_AEROSOL) == QA_HIGH_AEROSOL) if aerosol else out


#: Bits of the other product's quality band, the bits (low, high) of its two-bit levels, and what a mask takes if nothing else is asked for.
LC2_BITS = {"fill": 0, "dilated cloud": 1, "cirrus": 2, "cloud": 3, "cloud shadow": 4, "snow": 5, "clear": 6, "water": 7}
LC2_LEVELS = {"cloud confidence": (8, 9), "cloud shadow confidence": (10, 11), "snow/ice confidence": (12, 13), "cirrus confidence": (14, 15)}
LC2_DEFAULT = ("cloud", "cloud shadow", "snow", "water")
#: Fixed values: (low bit, high bit) of a level.
LEVELS = {"low": (1, 0), "moderate": (0, 1), "high": (1, 1)}


def lc2_masked(qa: Column, names: tuple[str, ...] = LC2_DEFAULT) -> Column:
    """Does any of the conditions hold? A name is that of a bit, or of a level with low, moderate or high behind it."""
    bit, out = lambda k: F.getbit(qa, F.lit(k)), F.lit(False)
    for name in names:
        if name in LC2_BITS:
            out = out | (bit(LC2_BITS[name]) == 1)
        else:
            kind, level = name.rsplit(" ", 1)
            for place, want in zip(LC2_LEVELS[kind], LEVELS[level]):
                part = bit(place) == want
                both = part if place == LC2_LEVELS[kind][0] else both & part
            out = out | both
    return out


def target(ndvi: Column, bad: Column, red: Column, low: float, high: float) -> Column:
    """The index by which scenes are ranked: null where masked or out of the red range."""
    return F.when(~(bad | (red < low) | (red > high)), ndvi)
