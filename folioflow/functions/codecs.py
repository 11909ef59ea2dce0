"""Encodings of ids, regions, points, routes and settings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_uuid(text: Column) -> Column:
    """Name-based UUID (version 3) of a text without a namespace: MD5 with the version and variant bits set."""
    h = F.md5(text)
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-"),
        F.element_at(F.array(*map(F.lit, "89ab")), nibble % 4 + 1), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def clamp_or(x: Column, low: float, high: float, default: float) -> Column:
    """The value within bounds; the default where it is null or not finite."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(default)).otherwise(clamp(x, low, high))


def decode_regions(text: Column, page: Column | None = None) -> Column:
    """`page,left,top,right,bottom` joined by `|` -> array of structs; a part without exactly five numbers, or on another
    page if one is given, is dropped."""
    parts = F.transform(F.split(text, r"\|"), lambda p: F.split(p, ","))

    def box(p: Column) -> Column:
        n = lambda i: F.get(p, F.lit(i)).try_cast("float")
        return F.struct(F.get(p, F.lit(0)).try_cast("int").alias("page"), n(1).alias("left"), n(2).alias("top"), n(3).alias("right"), n(4).alias("bottom"))

    whole = F.transform(F.filter(parts, lambda p: F.size(p) == 5), box)
    ok = lambda b: b["page"].isNotNull() & b["left"].isNotNull() & b["top"].isNotNull() & b["right"].isNotNull() & b["bottom"].isNotNull()
    return F.filter(whole, (lambda b: ok(b) & (b["page"] == page)) if page is not None else ok)


def encode_regions(regions: Column) -> Column:
    """The inverse, coordinates kept within the page."""
    c = lambda x: clamp(x, 0.0, 1.0).cast("float").cast("string")
    return F.array_join(F.transform(regions, lambda b: F.concat_ws(",", b["page"].cast("string"), c(b["left"]), c(b["top"]), c(b["right"]), c(b["bottom"]))), "|")


def encode_points(points: Column) -> Column:
    """Array of (x, y, pressure) -> `x,y,p` with 6, 6 and 4 decimals, joined by `;`."""
    return F.array_join(F.transform(points, lambda p: F.format_string("%.6f,%.6f,%.4f", p["x"].cast("double"), p["y"].cast("double"), p["pressure"].cast("double"))), ";")


def decode_points(text: Column) -> Column:
    """The inverse; parts that are not three numbers are dropped."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda p: F.split(p, ",")), lambda p: F.size(p) == 3)
    n = lambda p, i: F.get(p, F.lit(i)).try_cast("double")
    points = F.transform(parts, lambda p: F.struct(n(p, 0).alias("x"), n(p, 1).alias("y"), n(p, 2).alias("pressure")))
    return F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & p["pressure"].isNotNull())


#: The routes, and which of them need an argument or may have one.
ROUTES = ("library", "reader", "settings", "note", "vocabulary")
NEEDS_ARGUMENT, MAY_HAVE_ARGUMENT = ("reader", "note"), ("settings",)


def decode_route(text: Column) -> Column:
    """`type|argument` -> struct(kind, argument); an unknown type, or a blank argument where one is needed, raises."""
    kind = F.substring_index(text, "|", 1)
    arg = F.when(text.contains("|"), F.substring(text, F.length(kind) + 2, F.length(text))).otherwise(F.lit(""))
    bad = ~kind.isin(*ROUTES) | (kind.isin(*NEEDS_ARGUMENT) & (F.trim(arg) == ""))
    kept = F.when(kind.isin(*NEEDS_ARGUMENT, *MAY_HAVE_ARGUMENT) & (F.trim(arg) != ""), arg)
    return F.when(bad, F.raise_error(F.concat(F.lit("bad route: "), text)).cast("struct<kind:string,argument:string>")).otherwise(
        F.struct(kind.alias("kind"), kept.alias("argument")))


def encode_route(kind: Column, argument: Column) -> Column:
    return F.when(argument.isNull(), kind).otherwise(F.concat(kind, F.lit("|"), argument))


def setting(settings: Column, key: str, kind: str, default, low=None, high=None) -> Column:
    """A typed setting out of a map of strings: the default where it is missing or malformed, kept within bounds."""
    x = F.coalesce(F.try_element_at(settings, F.lit(key)).try_cast(kind), F.lit(default).cast(kind))
    return clamp(x, low, high).cast(kind) if low is not None else x
