"""Column builders shared by the checks: rounding, fingerprint packing, severity, display texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom.schema import SEVERITY_WEIGHT

FAR = 9007199254740991


def half_up(value: Column, places: int) -> Column:
    """Rounds halves up by floor, as a binary double multiplied and shifted; the sign of zero is kept plain."""
    scale = float(10**places)
    return F.floor(value * scale + 0.5) / scale


def fixed(value: Column, places: int) -> Column:
    """Text with so many decimals, halves away from zero."""
    return F.format_string(f"%.{places}f", value.cast("double"))


def laplacian_spread(pixels: Column, side: int) -> Column:
    """n^2 times the population variance of the clipped 4-neighbour Laplacian of a square grid of n pixels, edges repeated, in exact integers."""
    n = side * side
    at = lambda i: F.get(pixels, i.cast("int"))

    def response(i: Column) -> Column:
        up, down = F.when(i < side, i).otherwise(i - side), F.when(i >= n - side, i).otherwise(i + side)
        left, right = F.when(i % side == 0, i).otherwise(i - 1), F.when(i % side == side - 1, i).otherwise(i + 1)
        return F.greatest(F.lit(0), F.least(F.lit(255), at(up) + at(down) + at(left) + at(right) - at(i) * 4))

    zero = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("q"))
    made = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), response)
    return F.aggregate(made, zero, lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")), lambda a: a["q"] * n - a["s"] * a["s"])


def average_hash_bits(pixels: Column) -> Column:
    """Array of 0/1: whether each pixel is at least the mean. Integers only, so no rounding is involved."""
    total = F.aggregate(pixels, F.lit(0).cast("bigint"), lambda acc, p: acc + p)
    return F.transform(pixels, lambda p: F.when(p * F.size(pixels) >= total, 1).otherwise(0))


def packed_half(bits: Column, start: int) -> Column:
    """32 bits from ``start`` (counted from 1) as an unsigned value, the first bit highest."""
    return F.aggregate(F.slice(bits, start, 32), F.lit(0).cast("bigint"), lambda acc, b: acc * 2 + b)


def fingerprint_hex(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 8, "0"), F.lpad(F.hex(lo), 8, "0")))


def hamming_hex(a: Column, b: Column) -> Column:
    """Distance of two hex fingerprints; texts of different length are as far apart as can be."""
    half = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("bigint")
    bits = F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))
    return F.when(F.length(a) != F.length(b), F.lit(FAR)).otherwise(bits.cast("bigint"))


def severity_weight(severity: Column) -> Column:
    weight = F.lit(0)
    for name, value in SEVERITY_WEIGHT.items():
        weight = F.when(severity == name, F.lit(value)).otherwise(weight)
    return weight


def size_label(size: Column) -> Column:
    """Bytes in units of 1024 with one decimal at most."""
    label = F.lit("0 B")
    for power, unit in ((0, "B"), (1, "KB"), (2, "MB"), (3, "GB")):
        shown = half_up(size / float(1024**power), 1)
        whole = F.when(shown == F.floor(shown), F.floor(shown).cast("string")).otherwise(shown.cast("string"))
        label = F.when(size >= 1024**power, F.concat(whole, F.lit(f" {unit}"))).otherwise(label)
    return label


def age_label(then: Column, now: Column) -> Column:
    """JUST NOW within a minute, then whole minutes, hours or days ago."""
    s = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp"))
    shown = lambda unit, letter: F.concat(F.floor(s / unit).cast("string"), F.lit(f"{letter} AGO"))
    return F.when(s < 60, "JUST NOW").when(s < 3600, shown(60, "M")).when(s < 86400, shown(3600, "H")).otherwise(shown(86400, "D"))


def confidence_band(score: Column) -> Column:
    percent = F.floor(score * 100 + 0.5)
    return F.when(percent >= 80, "pass").when(percent >= 50, "warn").otherwise("fail")


def mime_badge(mime: Column) -> Column:
    kind = F.upper(F.get(F.split(mime, "/"), F.lit(1)))
    return F.when(kind.isNull() | (kind == ""), "IMG").otherwise(kind)
