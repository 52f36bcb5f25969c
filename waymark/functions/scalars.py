"""Scalar helpers as column expressions: numbers, strings, hashes, arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def huber_weight(residual: Column, threshold: float) -> Column:
    """1 up to the threshold, threshold / residual beyond."""
    a = F.abs(residual)
    return F.when(a <= threshold, 1.0).otherwise(F.lit(threshold) / a)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def safe_acos(x: Column) -> Column:
    return F.acos(clamp(x, -1.0, 1.0))


def rounded(x: Column, digits: int = 6) -> Column:
    """Half-even rounding, and never a negative zero."""
    return F.bround(x, digits) + F.lit(0.0)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(v.cast("array<double>"))


def hamming_window(length: int) -> Column:
    """0.54 - 0.46 cos(2 pi n / (length - 1)) as an array; the last element is 0."""
    import math

    return F.array(*(F.lit(0.54 - 0.46 * math.cos(2 * math.pi * n / (length - 1))) for n in range(length - 1)), F.lit(0.0))


def hamming_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def split_nonempty(s: Column, separator: str) -> Column:
    """Pieces between separators, without the empty ones."""
    import re

    return F.filter(F.split(s, re.escape(separator)), lambda x: x != "")


def pad(s: Column, n: int, filler: str = " ") -> Column:
    """Filled up on the right; never cut."""
    return F.when(F.length(s) >= n, s).otherwise(F.rpad(s, n, filler))


def is_integer(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^-?[0-9]+$"), F.lit(False))


def is_number(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^-?[0-9]+([.,][0-9]+)?$"), F.lit(False))


def number_pieces(s: Column) -> Column:
    """Runs of digits and of other characters, in order."""
    return F.regexp_extract_all(s, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))


def natural_key(s: Column) -> Column:
    """A key under which numbers inside text sort by value: digits are filled up to 19 places."""
    return F.array_join(F.transform(number_pieces(s), lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 19, "0")).otherwise(p)), "")


def slug(s: Column, fallback: str = "map", limit: int = 64) -> Column:
    """Runs of characters other than letters, digits, dot, underscore and hyphen become a hyphen; A-Z alone is folded."""
    base = F.regexp_replace(F.coalesce(s, F.lit("")), r"[^A-Za-z0-9._-]+", "-")
    folded = F.translate(base, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = F.substring(F.regexp_replace(folded, r"^-+|-+$", ""), 1, limit)
    return F.when(F.length(cut) == 0, F.lit(fallback)).otherwise(cut)


def stable_id(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, length)


def statistics_to_text(m: Column) -> Column:
    """``key:value;key:value`` in key order."""
    entries = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ";")


def statistics_from_text(s: Column) -> Column:
    return F.transform_values(F.str_to_map(s, F.lit(";"), F.lit(":")), lambda _k, v: v.cast("double"))


def either_field(record: Column, snake: str, camel: str) -> Column:
    """A field of a JSON text under either spelling."""
    return F.coalesce(F.get_json_object(record, f"$.{snake}"), F.get_json_object(record, f"$.{camel}"))


def column_number(letters: Column) -> Column:
    """1 for A, 27 for AA."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise(s * 26 + (F.ascii(c) - 64)))


def column_letters(n: Column, places: int = 14) -> Column:
    """A for 1, AA for 27; fourteen letters hold every 64-bit number."""
    n, pieces, shorter, unit = n.cast("long"), [], 0, 1
    for _ in range(places):
        # shorter: how many numbers have fewer letters than reach this one
        digit = F.call_function("div", n - 1 - F.lit(shorter).cast("long"), F.lit(unit).cast("long")) % 26
        pieces.append(F.when(n > shorter, F.char(digit + 65)).otherwise(""))
        unit *= 26
        shorter += unit
    return F.concat(*reversed(pieces))


def cell_reference(ref: Column) -> Column:
    """(row, column) of a reference such as AB12; null and 0 where it is none."""
    return F.struct(F.regexp_extract(ref, r"^[A-Z]+([0-9]+)$", 1).try_cast("int").alias("row"), column_number(F.regexp_extract(ref, r"^([A-Z]+)[0-9]+$", 1)).alias("column"))


def utc_text(seconds: Column, offset_seconds: int = 0) -> Column:
    """ISO text with an explicit offset, for a session in UTC."""
    sign = "-" if offset_seconds < 0 else "+"
    a = abs(offset_seconds)
    tail = "Z" if not offset_seconds else f"{sign}{a // 3600:02d}:{a % 3600 // 60:02d}"
    return F.concat(F.date_format(F.timestamp_seconds(seconds + offset_seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(tail))


def strict_kind(json_value: Column) -> Column:
    """Kind of a JSON scalar's text: integer, number, bool, null or string."""
    return (
        F.when(json_value.isNull() | (json_value == "null"), "null").when(json_value.isin("true", "false"), "bool")
        .when(json_value.rlike(r"^-?(0|[1-9][0-9]*)$"), "integer").when(json_value.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "number").otherwise("string")
    )


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """Colour from hue in degrees and saturation and value in 0..1, as three numbers in 0..1."""

    def part(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h / 60, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, F.lit(4.0) - k, F.lit(1.0)))

    return F.array(part(5), part(3), part(1))
