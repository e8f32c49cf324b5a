"""What file names and paths say: dates, products, projections, places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latitude band letters of the military grid: a fixed value.
BANDS = "C-HJ-NP-X"


def first_date(name: Column) -> Column:
    """First run of eight digits as a date."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"([0-9]{8})", 1), F.lit("")), F.lit("yyyyMMdd")).cast("date")


def date_range(name: Column) -> tuple[Column, Column]:
    """The two dates of the first yyyyMMdd_yyyyMMdd (or with a dash); null where there is none."""
    part = lambda k: F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"([0-9]{8})[_-]([0-9]{8})", k), F.lit("")), F.lit("yyyyMMdd")).cast("date")
    return part(1), part(2)


def middle(name: Column) -> Column:
    """Midpoint of the name's date range (may be noon), else its single date, else null."""
    a, b = date_range(name)
    us = lambda d: F.unix_micros(d.cast("timestamp"))
    mid = F.timestamp_micros(us(a) + ((us(b) - us(a)) / 2).cast("bigint"))
    return F.coalesce(mid, first_date(name).cast("timestamp"))


def utm_epsg(tile: Column, scene: Column | None = None, default: int = 32639) -> Column:
    """EPSG code of the first grid-zone mark such as T39QXG in tile, else in scene, else default. Bands from N on are north."""

    def of(c: Column) -> Column:
        zone = F.regexp_extract(c, rf"(?i)T([0-9]{{2}})([{BANDS}])", 1)
        band = F.upper(F.regexp_extract(c, rf"(?i)T([0-9]{{2}})([{BANDS}])", 2))
        return F.when(zone != "", F.when(band >= "N", 32600).otherwise(32700) + zone.cast("int"))

    return F.coalesce(of(tile), of(scene) if scene is not None else F.lit(None).cast("int"), F.lit(default))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def product(path: Column, tokens: dict[str, tuple[str, ...]], needs: tuple[str, ...] = ()) -> Column:
    """First product all of whose tokens the lower-cased file name holds, with all of needs; null for none."""
    name = F.lower(file_name(path))
    out = F.lit(None).cast("string")
    for key, parts in reversed(list(tokens.items())):
        ok = F.lit(True)
        for p in (*parts, *needs):
            ok = ok & F.contains(name, F.lit(p.lower()))
        out = F.when(ok, F.lit(key)).otherwise(out)
    return out


def first_containing(text: Column, words: tuple[str, ...], default: str | None = None) -> Column:
    """The first of words that the lower-cased text holds."""
    out = F.lit(default).cast("string")
    for w in reversed(words):
        out = F.when(F.contains(F.lower(text), F.lit(w)), F.lit(w)).otherwise(out)
    return out


def without_prefix(text: Column, prefix: str) -> Column:
    """The first occurrence of prefix removed."""
    at = F.instr(text, prefix)
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + len(prefix)))).otherwise(text)


def query_url(base: Column, variable: Column, time: Column, south: Column, north: Column, west: Column, east: Column, *, east_360: bool = False) -> Column:
    """Grid query: variable[(time)][(south):(north)][(west):(east)], percent-encoded, longitudes moved to 0-360 on request."""
    lon = (lambda x: F.when(x < 0, x + 360).otherwise(x)) if east_360 else (lambda x: x)
    q = F.format_string("%s[(%s)][(%s):(%s)][(%s):(%s)]", variable, time, south.cast("string"), north.cast("string"), lon(west).cast("string"), lon(east).cast("string"))
    return F.concat(base, F.lit("?"), F.url_encode(q))


def http_date(t: Column) -> Column:
    return F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
