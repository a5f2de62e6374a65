"""Row-level expressions on names, flags, dates and coordinates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Land-cover codes and the canopy height (m) below which a segment of that class is plausible.
HEIGHT_CEILING = {
    0: 0, 20: 20, 30: 10, 40: 0, 50: 0, 60: 5, 70: 0, 80: 0, 90: 10, 100: 5,
    111: 60, 112: 60, 113: 60, 114: 60, 115: 60, 116: 60,
    121: 50, 122: 50, 123: 50, 124: 50, 125: 50, 126: 50, 200: 0,
}
#: Places (from 0) of the percentiles in a segment's canopy height array.
HEIGHT_PLACES = {"rh25": 3, "rh50": 8, "rh60": 10, "rh70": 12, "rh75": 13, "rh80": 14, "rh85": 15, "rh90": 16, "rh95": 17}
#: Labels of land-cover codes, of snow, cloud and night flags.
LAND_COVER = {
    0: "No data", 20: "Shrubs", 30: "Herbaceous", 40: "Cultivated/managed", 50: "Urban/built", 60: "Bare/sparse", 70: "Snow/ice", 80: "Permanent\nwater", 90: "Herbaceous\nwetleand", 100: "Moss/lichen",
    111: "Closed forest\nevergreen needle", 112: "Closed forest\nevergreen_broad", 113: "Closed forest\ndeciduous needle", 114: "Closed forest\ndeciduous broad", 115: "Closed forest\nmixed", 116: "Closed forest\nunknown",
    121: "Open forest\nevergreen needle", 122: "Open forest evergreen_broad", 123: "Open forest deciduous needle", 124: "Open forest deciduous_broad", 125: "Open forest mixed", 126: "Open forest unknown", 200: "Open sea",
}
SNOW = {0: "ice free water", 1: "snow free land", 2: "snow", 3: "ice"}
CLOUD = {0: "high confidence clear", 1: "medium confidence clear", 2: "low confidence clear", 3: "low confidence cloudy", 4: "medium confidence cloudy", 5: "high confidence cloudy"}
NIGHT = {0: "day", 1: "night"}


def labelled(code: Column, labels: Mapping[int, str]) -> Column:
    """The label of a code; codes without one give null."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), code)


def leading(df, *columns: str):
    """lon and lat first, then the given columns."""
    return df.select("lon", "lat", *[c for c in columns if c not in ("lon", "lat")])


def to_https(path: Column, bucket_host: str = "s3.amazonaws.com") -> Column:
    """s3://bucket/key as the https address of the same object."""
    return F.regexp_replace(path, "^s3://([^/]+)/(.*)$", f"https://$1.{bucket_host}/$2")


def file_stem(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def version_swapped(name: Column, old: str, new: str) -> Column:
    """A version token in a file name, as a whole token between separators, replaced by another."""
    return F.regexp_replace(name, f"(^|[_./]){old}(?=[_./]|$)", f"$1{new}")


def scene_day(scene: Column, product: str) -> dict[str, Column]:
    """year and day of year from a scene's file name: yyyyddd in the fourth dotted token, or yyyymmdd in the fourth underscored one."""
    name = F.element_at(F.split(scene, "/"), -1)
    if product == "HLS":
        token = F.get(F.split(name, r"\."), F.lit(3))
        return {"year": F.substr(token, F.lit(1), F.lit(4)).try_cast("int"), "doy": F.substr(token, F.lit(5), F.lit(3)).try_cast("int")}
    day = F.try_to_timestamp(F.get(F.split(name, "_"), F.lit(3)), F.lit("yyyyMMdd"))
    return {"year": F.year(day), "doy": F.dayofyear(day)}


def beam_strength(orientation: Column, track: Column) -> Column:
    """Strong or Weak from the craft's orientation and the track's side; null in transition."""
    right = track.endswith("r")
    left = track.endswith("l")
    return F.when(((orientation == 1) & right) | ((orientation == 0) & left), "Strong").when(((orientation == 1) & left) | ((orientation == 0) & right), "Weak")


def spot_strength(spot: Column) -> Column:
    return F.when(spot.between(1, 6), F.when(spot % 2 == 1, "strong").otherwise("weak"))


def number(text: Column, kind: str = "double") -> Column:
    """The number a text holds, or null."""
    return text.try_cast(kind)


def heights(metrics: Column) -> dict[str, Column]:
    return {name: F.get(metrics, F.lit(k)) for name, k in HEIGHT_PLACES.items()}


def date_parts(text: Column) -> dict[str, Column]:
    """Year, month, day and day of year of a timestamp text that may be wrapped as b'...'."""
    at = F.try_to_timestamp(F.regexp_replace(text, r"""^b?['"]|['"]$""", ""))
    return {"y": F.year(at), "m": F.month(at), "d": F.dayofmonth(at), "doy": F.dayofyear(at)}


def name_token(name: Column, k: int, strip: str = "") -> Column:
    """The k-th token (from 0) between underscores, without the given characters at its ends."""
    token = F.get(F.split(name, "_"), F.lit(k))
    return F.btrim(token, F.lit(strip)) if strip else token


def swap_root(path: Column, old: str, new: str) -> Column:
    """A path under another root."""
    return F.replace(path, F.lit(old), F.lit(new))


def padded(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def run_type(*parameters: Column) -> Column:
    """Parameters that are there, joined by underscores."""
    return F.concat_ws("_", *parameters)


def truncated(x: Column, decimals: int) -> Column:
    """Cut towards zero."""
    scale = float(10**decimals)
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def near_antimeridian(lon: Column) -> Column:
    return F.abs(lon) > 179.9999


def decimal_year(year: Column, doy: Column, first: int | None = None, last: int | None = None) -> Column:
    """year + doy / 365.25; null outside of the given years."""
    out = year + doy / 365.25
    return out if first is None else F.when(year.between(first, last), out)


def truth(text: Column) -> Column:
    """Is a text a beginning of TRUE?"""
    return F.lit("TRUE").startswith(F.upper(text))


def class_ranges(text: str) -> list[tuple[int, int, str]]:
    """(low, high, label) of "0-10:young,11-20:middle"."""
    out = []
    for part in text.split(","):
        span, label = part.split(":")
        low, high = span.split("-")
        out.append((int(low), int(high), label.strip()))
    return out


def last_token_number(name: Column) -> Column:
    return F.regexp_extract(name, r"([0-9]+)[^0-9]*$", 1).try_cast("int")


def month_end(day: Column) -> Column:
    return F.dayofmonth(F.last_day(day))


def clean_label(label: Column) -> Column:
    """Lower case, spaces as underscores, full stops dropped."""
    return F.translate(F.lower(label), " .", "_")


def canopy_cover(canopy: Column, top: Column, ground: Column) -> Column:
    return F.try_divide(canopy + top, canopy + top + ground)


def decibel(x: Column) -> Column:
    return 10 * F.log10(x)


#: A pixel's hectares, petagrams in a megagram, a tile's hectares.
PIXEL_HA, PG, TILE_HA = 0.09, 1e-9, 810000.0


def stock_pg(density: Column) -> Column:
    return density * PIXEL_HA * PG


def variance(sd: Column) -> Column:
    return sd * sd


def tile_density(stock: Column) -> Column:
    return stock * 1e9 / TILE_HA


def bounds_as_lon_lat(b: Column) -> Column:
    """(x0, x1, y0, y1) from (x0, y0, x1, y1)."""
    return F.array(b[0], b[2], b[1], b[3])


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def all_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
