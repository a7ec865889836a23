"""Column expressions: names, times, geometry, boxes, series and buckets. All stay inside code generation or built-in array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """True only for a number that is neither null nor NaN: NaN compares above every number in Spark."""
    return x.isNotNull() & ~F.isnan(x)


def at_least(x: Column, threshold: float) -> Column:
    return F.coalesce((x >= threshold) & finite(x), F.lit(False))


# names


def stem(name: Column) -> Column:
    """Name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def last_digits(name: Column) -> Column:
    """The last ``_`` token of the stem that is all digits; null without one."""
    return F.try_element_at(F.filter(F.split(stem(name), "_"), lambda x: x.rlike("^[0-9]+$")), F.lit(-1))


def loose_stem(name: Column) -> Column:
    """The stem before its last ``_`` token; the whole stem where there is none."""
    s = stem(name)
    return F.coalesce(F.nullif(F.regexp_extract(s, r"^(.+)_[^_]*$", 1), F.lit("")), s)


def scene_and_tile(name: Column) -> tuple[Column, Column]:
    """(scene number, tile number) of names like ``..._032001_..._RFI_17``; null where absent."""
    scene = F.nullif(F.regexp_extract(name, r"(?i)-(\d{6})-", 1), F.lit(""))
    tile = F.nullif(F.regexp_extract(name, r"(?i)(?:RFI|VD|DVD)_(\d+)", 1), F.lit(""))
    return scene.cast("bigint"), tile.cast("bigint")


def polarisation(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike(r"[-_]vv[-_]"), "vv").when(low.rlike(r"[-_]vh[-_]"), "vh").otherwise("unknown")


def padded_areas(text: Column) -> Column:
    """``1, 2,10`` to [01, 02, 10]; blanks are dropped."""
    return F.transform(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x))


def product_parts(name: Column) -> dict[str, Column]:
    """Tokens of ``s1a-iw-raw-s-vv-start-stop-orbit-take-IW1-RFI_7.ext`` by position; null for other shapes."""
    tokens = F.split(stem(name), "-")
    whole = F.size(tokens) >= 11
    take = lambda i: F.when(whole, F.element_at(tokens, i))
    last = F.element_at(tokens, -1)
    return {
        "pol": take(5), "start": F.upper(take(6)), "stop": F.upper(take(7)), "orbit": take(8), "take": F.upper(take(9)),
        "swath": F.when(whole, F.regexp_extract(F.element_at(tokens, 10), r"IW(\d)", 1).cast("int")),
        "kind": F.when(whole, F.regexp_replace(F.regexp_extract(last, r"^([A-Z]+)_", 1), "^VD$", "DVD")),
        "patch": F.when(whole, F.regexp_extract(last, r"_(\d+)", 1).cast("bigint")),
    }


def polarisation_class(product: Column) -> Column:
    return F.when(product.contains("DV"), "DV").when(product.contains("SV"), "SV").when(product.contains("SH"), "SH").when(product.contains("DH"), "DH")


def scene_of(path: Column) -> Column:
    """The first path segment that names a mission, else the longest (the first of equals), without ``.SAFE``."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    named = F.try_element_at(F.filter(parts, lambda x: x.startswith("S1A_") | x.startswith("S1B_")), F.lit(1))
    longest = F.try_element_at(F.array_sort(F.transform(parts, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))), F.lit(1))["x"]
    return F.regexp_replace(F.coalesce(named, longest), r"\.SAFE$", "")


def natural_key(name: Column) -> Column:
    """Sort key in which letters compare without case and runs of digits, of any length, as numbers; texts and numbers alternate, a text first."""
    lower = F.lower(name)
    parts = F.regexp_extract_all(lower, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    parts = F.when(lower.rlike("^[0-9]"), F.concat(F.array(F.lit("")), parts)).otherwise(parts)
    plain = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    return F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(plain(x)).cast("string"), 10, "0"), plain(x))).otherwise(x))


# times


def parse_stamp(text: Column) -> Column:
    """``YYYYMMDD_HHMMSS`` or ISO with fractions; null for anything else."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyyMMdd_HHmmss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")))


def stamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


#: First second (UTC) at which GPS runs ahead of UTC by so many seconds.
LEAPS = [("1999-01-01", 13), ("2006-01-01", 14), ("2009-01-01", 15), ("2012-07-01", 16), ("2015-07-01", 17), ("2017-01-01", 18)]


def gps_seconds(ts: Column) -> Column:
    """Seconds since 1980-01-06, leap seconds counted (from 1999 on)."""
    leap = F.lit(12)
    for day, seconds in LEAPS:
        leap = F.when(ts >= F.lit(day).cast("timestamp"), F.lit(seconds)).otherwise(leap)
    return F.unix_micros(ts.cast("timestamp")) / 1e6 - 315964800 + leap


# geometry and signal


def wrap_longitude(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0088) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))) + 360, F.lit(360.0))


def destination(lat: Column, lon: Column, bearing: Column, km: Column, radius: float = 6371.0088) -> tuple[Column, Column]:
    """(lat, lon) reached from a point; spherical."""
    a, t, d = F.radians(lat), F.radians(bearing), km / radius
    to = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t))
    turn = F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(to))
    return F.degrees(to), wrap_longitude(lon + F.degrees(turn))


def contrast_db(region: Column, background: Column, eps: float = 1e-12) -> Column:
    return 10 * F.log10(F.greatest(region, F.lit(eps)) / F.greatest(background, F.lit(eps)))


def amplitude(i: Column, q: Column, eps: float = 0.0) -> Column:
    return F.sqrt(i * i + q * q + eps)


def phase(i: Column, q: Column, degrees: bool = False) -> Column:
    return F.degrees(F.atan2(q, i)) if degrees else F.atan2(q, i)


def clip(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, F.lit(lo) if not isinstance(lo, Column) else lo), F.lit(hi) if not isinstance(hi, Column) else hi)


def log_scaled(x: Column, lo: Column, hi: Column) -> Column:
    """log1p, clipped to [lo, hi] and scaled to [0, 1]; 0 where the interval is empty."""
    return F.when(hi > lo, (clip(F.log1p(x), lo, hi) - lo) / (hi - lo)).otherwise(F.lit(0.0))


# boxes


def six(x: Column) -> Column:
    """Six decimals, ties to even."""
    return F.format_string("%.6f", F.bround(x, 6))


def pose_line(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column, cls: int = 0) -> Column:
    """``class xc yc w h xc yc 2``, normalised, 6 decimals."""
    xc, yc = six((left + right) / 2 / width), six((top + bottom) / 2 / height)
    return F.concat_ws(" ", F.lit(str(cls)), xc, yc, six((right - left) / width), six((bottom - top) / height), xc, yc, F.lit("2"))


def pixel_box(xc: Column, yc: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Corners in whole pixels, truncated."""
    cut = lambda x: x.cast("int")
    return F.struct(cut((xc - w / 2) * width).alias("left"), cut((yc - h / 2) * height).alias("top"), cut((xc + w / 2) * width).alias("right"), cut((yc + h / 2) * height).alias("bottom"))


def inflated(xc: Column, yc: Column, w: Column, h: Column, pad_x: Column, pad_y: Column) -> Column:
    """Box grown on each side; size is clamped to the image first, then the centre."""
    one = F.lit(1.0)
    wide, high = F.least(w + 2 * pad_x, one), F.least(h + 2 * pad_y, one)
    x = F.greatest(wide / 2, F.least(xc, 1 - wide / 2))
    y = F.greatest(high / 2, F.least(yc, 1 - high / 2))
    return F.struct(x.alias("xc"), y.alias("yc"), wide.alias("w"), high.alias("h"))


def inflated_line(line: Column, width: Column, height: Column, padding: float) -> Column:
    """The same on a label line: further fields are kept, a line of under five fields passes through."""
    parts = F.split(F.trim(line), r"\s+")
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    box = inflated(number(2), number(3), number(4), number(5), F.lit(float(padding)) / width, F.lit(float(padding)) / height)
    made = F.concat_ws(" ", F.concat(F.array(F.element_at(parts, 1), six(box["xc"]), six(box["yc"]), six(box["w"]), six(box["h"])), F.slice(parts, 6, 1000)))
    return F.when(F.size(parts) >= 5, made).otherwise(line)


def centred_box(col: Column, row: Column, half_w: Column, half_h: Column, size: int = 512) -> Column:
    """Corners from centre and half size: half-even rounding, clipped to 1..size, in order."""
    edge = lambda x: clip(F.rint(x), 1.0, float(size)).cast("int")
    xs, ys = (F.array_sort(F.array(edge(c - d), edge(c + d))) for c, d in ((col, half_w), (row, half_h)))
    return F.struct(ys[0].alias("top"), xs[0].alias("left"), ys[1].alias("bottom"), xs[1].alias("right"))


# series


def float_series(text: Column) -> Column:
    """White-space separated numbers; tokens that are not finite numbers are dropped."""
    tokens = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    return F.filter(F.transform(tokens, lambda x: x.try_cast("double")), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def paired_series(xs: Column, ys: Column, least: int = 3) -> Column:
    """array<struct(x, y)> cut to the common length; null under ``least`` points."""
    a, b = float_series(xs), float_series(ys)
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.when(n >= least, pairs)


def ceil_to(x: Column, multiple: int) -> Column:
    return (F.ceil(x / multiple) * multiple).cast("bigint")


# buckets: wind 4/8, size 50/150, density 1/4, shore 5/20
BUCKETS = {"wind": (4.0, 8.0), "size": (50.0, 150.0), "density": (1.0, 4.0), "shore": (5.0, 20.0)}


def bucket(x: Column, kind: str) -> Column:
    """``kind_low``, ``kind_mid`` or ``kind_high``; null and NaN are in none."""
    lo, hi = BUCKETS[kind]
    return F.when(~finite(x), None).when(x < lo, f"{kind}_low").when(x < hi, f"{kind}_mid").otherwise(f"{kind}_high")


def buckets(**values: Column) -> Column:
    return F.array_compact(F.array(*[bucket(x, kind) for kind, x in values.items()]))
