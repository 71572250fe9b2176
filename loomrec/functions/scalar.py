"""Scalar functions over columns: ids, wildcards, numbers in text, curves, bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def id_text(form_id: Column) -> Column:
    """An id as 0x and at least eight hexadecimal digits."""
    return F.format_string("0x%08X", form_id)


def looks_like_id(text: Column) -> Column:
    """Optional 0x, then one to eight hexadecimal digits."""
    return F.trim(text).rlike(r"^(0[xX])?[0-9a-fA-F]{1,8}$")


def parse_id(text: Column) -> Column:
    """An id from text: 0x is hexadecimal; without it up to eight digits with a letter are, and digits alone are decimal. Null if none."""
    clean = F.trim(text)
    hexadecimal = F.conv(F.regexp_replace(clean, "^0[xX]", ""), 16, 10).cast("long")
    return (
        F.when(clean.rlike("^0[xX][0-9a-fA-F]{1,8}$"), hexadecimal)
        .when(clean.rlike("^[0-9a-fA-F]{1,8}$") & clean.rlike("[a-fA-F]"), hexadecimal)
        .when(clean.rlike("^[0-9]{1,18}$"), clean.try_cast("long"))
    )


def wildcard(text: Column, pattern: str) -> Column:
    """Case-insensitive match: without * the pattern is found anywhere, with * it is anchored and each * is any run."""
    low = F.lower(text)
    if "*" not in pattern:
        return low.contains(pattern.lower())
    escaped = pattern.lower().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
    return low.like(escaped)


def exact_or_glob(text: Column, pattern: str, spaces: bool = True) -> Column:
    """Equal without regard to case, or a wildcard if the pattern has *; ``spaces=False`` ignores white space on both sides."""
    if not spaces:
        text, pattern = F.regexp_replace(text, r"\s", ""), "".join(pattern.split())
    return wildcard(text, pattern) if "*" in pattern else F.lower(text) == pattern.lower()


def any_of(value: Column, patterns: list[str]) -> Column:
    """Whether any shell pattern (*, ?, [..]) matches the whole value, without regard to case."""
    import fnmatch

    found = F.lit(False)
    for p in patterns:
        # fnmatch writes \Z (or \z) at the end, Java takes $.
        found = found | F.lower(value).rlike("^" + fnmatch.translate(p.lower()).replace("\\Z", "$").replace("\\z", "$"))
    return found


def type_list(text: Column) -> Column:
    """Upper-cased, trimmed entries of a comma-separated list, empty ones left out."""
    return F.filter(F.transform(F.split(text, ","), lambda s: F.upper(F.trim(s))), lambda s: s != "")


def short_float(value: Column) -> Column:
    """A 32-bit float as the double that its shortest text means; NaN and infinities are null."""
    single = value.cast("float")
    return F.when(F.isnan(single) | (F.abs(single) == float("inf")), None).otherwise(single.cast("string").cast("double"))


def inline_text(text: Column) -> Column:
    """Text without a leading <ID=...> mark; empty text is null."""
    return F.nullif(F.regexp_replace(text, r"^<ID=[^>]*>\s*", ""), F.lit(""))


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))


def zstring(data: Column) -> Column:
    """The text up to the first zero byte."""
    return F.substring_index(F.decode(data, "utf-8"), "\0", 1)


def flag_names(value: Column, names: list[str]) -> Column:
    """The names of the bits that are set."""
    return F.filter(F.array(*[F.when(F.getbit(value, F.lit(i)) == 1, n) for i, n in enumerate(names)]), lambda n: n.isNotNull())


def curve_value(points: Column, x: Column) -> Column:
    """A piecewise-linear curve at x: points (x, y) in order of x, held level beyond both ends; null without points."""
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    n = F.size(points)
    left = F.filter(points, lambda p: p["x"] < x)
    a = F.element_at(left, -1)
    b = points[F.least(F.size(left), n - 1)]
    slope = F.when(b["x"] == a["x"], a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * (x - a["x"]) / (b["x"] - a["x"]))
    return F.when(n == 0, None).when(x <= first["x"], first["y"]).when(x >= last["x"], last["y"]).otherwise(slope)


def curve_range(points: Column) -> Column:
    """Least and greatest y of a curve."""
    ys = F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(ys).alias("low"), F.array_max(ys).alias("high"))


def resisted(damage: Column, resist: Column) -> Column:
    """Damage that gets through a resistance."""
    share = F.pow(0.15 * damage / resist, F.lit(0.365))
    return damage * F.when(resist <= 0, 0.99).otherwise(F.greatest(F.lit(0.01), F.least(F.lit(0.99), share)))


def numbers_in(text: Column) -> Column:
    """The numbers that stand in a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)"), 1), lambda s: s.cast("double"))


def has_number(text: Column, value: Column) -> Column:
    return F.exists(numbers_in(text), lambda n: F.abs(n - value) < 1e-9)


def truthy(value: Column) -> Column:
    """Text that is neither null, empty, 0, false nor none."""
    return F.coalesce(~F.lower(F.trim(value)).isin("", "0", "false", "none"), F.lit(False))
