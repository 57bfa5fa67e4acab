"""Percentiles of very large columns from mergeable counts in signed logarithmic buckets.

Bucket k > 0 holds the positive values x with gamma**(k-1) < x <= gamma**k, a mirrored one the
negative values, and one bucket the zeros, with gamma = (1 + a) / (1 - a). Whatever value of the
bucket was meant, the one reported is off by at most the relative error ``a``. A sketch
is a table (group columns, sign, bucket, n): adding the counts of equal buckets merges
sketches of partitions or days without further error, and its size follows the
range of the values, not their number (about 2,200 buckets from 1 to 2**31 at 1 %).

Nulls, NaN and infinities are not counted. A group without values has no row in the
sketch and none in the result. Ties share a bucket. Percentile p is the value at rank
ceil(p * n), at least 1, of the sorted values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.operators.skew import hot_of, salted
from frameloom.session import Scratch

RELATIVE_ERROR = 0.01
PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def gamma_of(error: float) -> float:
    return (1 + error) / (1 - error)


def bucket_of(value: Column, error: float = RELATIVE_ERROR) -> Column:
    """Bucket number of the magnitude; 0 for zero (the sign tells it from magnitudes near 1)."""
    width = math.log(gamma_of(error))
    return F.when(value == 0, F.lit(0)).otherwise(F.ceil(F.log(F.abs(value)) / F.lit(width))).cast("int")


def value_of(sign: Column, bucket: Column, error: float = RELATIVE_ERROR) -> Column:
    """The value of a bucket whose relative distance to both its ends is equal."""
    gamma = gamma_of(error)
    return sign * F.lit(2.0 / (gamma + 1)) * F.pow(F.lit(gamma), bucket)


def sketch(df: DataFrame, by: list[str], value: Column, error: float = RELATIVE_ERROR) -> DataFrame:
    """(by..., sign, bucket, n) of the finite values; partial counts come before the shuffle."""
    held = df.select(*by, value.cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x") & (F.abs("_x") < float("inf")))
    return held.groupBy(*by, F.signum("_x").cast("int").alias("sign"), bucket_of(F.col("_x"), error).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Add matching buckets over everything but ``by``, for example over days."""
    return sketches.groupBy(*by, "sign", "bucket").agg(F.sum("n").alias("n"))


def percentiles(merged: DataFrame, by: list[str], points: tuple[float, ...] = PERCENTILES, error: float = RELATIVE_ERROR) -> DataFrame:
    """(by..., percentile, n_values, estimate, relative_error) from a merged sketch."""
    group = Window.partitionBy(*by)
    order = group.orderBy("sign", F.col("sign") * F.col("bucket"))
    placed = merged.withColumns({"upto": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(group)})
    asked = placed.withColumn("percentile", F.explode(F.array(*[F.lit(p) for p in points])))
    rank = F.greatest(F.ceil(F.round(F.col("percentile") * F.col("total"), 6)), F.lit(1))
    hit = asked.where((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank))
    return hit.select(*by, "percentile", F.col("total").alias("n_values"), value_of(F.col("sign"), F.col("bucket"), error).alias("estimate"), F.lit(error).alias("relative_error"))


def mime_kind(mime: Column) -> Column:
    """One name for each kind: case, blanks, parameters and jpg/jpeg aside; ``unknown`` for no kind."""
    bare = F.regexp_replace(F.lower(F.split(mime, ";")[0]), r"\s+", "")
    return F.when(bare.isNull() | (bare == ""), "unknown").when(bare.isin("image/jpg", "image/pjpeg"), "image/jpeg").otherwise(bare)


def measures(images: DataFrame) -> DataFrame:
    """(day as text, kind, measure, x): the two measured columns of ``image``, one below the other."""
    size = F.when((F.col("size_bytes") >= 1) & (F.col("size_bytes") < 2147483647), F.col("size_bytes").cast("double"))
    score = F.col("analysis_result.confidence_score")
    score = F.when(~F.isnan(score) & (score >= 0) & (score <= 1), score)
    both = F.array(F.struct(F.lit("size_bytes").alias("measure"), size.alias("x")), F.struct(F.lit("confidence_score").alias("measure"), score.alias("x")))
    return images.select(F.to_date("uploaded_at").cast("string").alias("day"), mime_kind(F.col("mime_type")).alias("kind"), F.inline(both)).where(F.col("x").isNotNull())


def daily_sketches(images: DataFrame, error: float = RELATIVE_ERROR) -> DataFrame:
    return sketch(measures(images), ["day", "kind", "measure"], F.col("x"), error)


def image_percentiles(images: DataFrame, points: tuple[float, ...] = PERCENTILES, error: float = RELATIVE_ERROR) -> DataFrame:
    """From the written results of the days, which are all that is read for it."""
    by = ["kind", "measure"]
    daily = Scratch(images.sparkSession, "sketches").write(daily_sketches(images, error), "daily")
    return percentiles(merge(daily, by), by, points, error)


def kept_promise(images: DataFrame, points: tuple[float, ...] = PERCENTILES, error: float = RELATIVE_ERROR) -> DataFrame:
    """(kind, measure, percentile, within): whether the value at the rank lies within the stated error of the estimate.

    Nothing is sorted: the values below and up to the error's bounds are counted, and the rank must lie between the counts.
    """
    scratch = Scratch(images.sparkSession, "promise")
    told = scratch.write(image_percentiles(images, points, error), "told")
    slack = 1e-9
    est = F.col("estimate")
    asked = told.select(
        F.concat_ws("|", "measure", "kind").alias("g"), "kind", "measure", "percentile", "n_values",
        (F.least(est / (1 + error), est / (1 - error)) * (1 - F.signum(est) * slack)).alias("low"), (F.greatest(est / (1 + error), est / (1 - error)) * (1 + F.signum(est) * slack)).alias("high"),
    )
    values, n = scratch.write_counted(measures(images).select(F.concat_ws("|", "measure", "kind").alias("g"), "x"), "values")
    mine, theirs = salted(values, asked.groupBy("g").agg(F.collect_list(F.struct("percentile", "low", "high")).alias("asked")), "g", F.monotonically_increasing_id(), n["n"], hot_of(told.select(F.concat_ws("|", "measure", "kind").alias("g"), "n_values").distinct(), "g", "n_values", n["n"]))
    flat = mine.join(theirs, ["g", "_salt"]).select("g", "x", F.explode("asked").alias("a"))
    counts = flat.groupBy("g", F.col("a.percentile").alias("percentile")).agg(F.count_if(F.col("x") < F.col("a.low")).alias("below"), F.count_if(F.col("x") <= F.col("a.high")).alias("upto"))
    rank = F.greatest(F.ceil(F.round(F.col("percentile") * F.col("n_values"), 6)), F.lit(1))
    return asked.join(counts, ["g", "percentile"]).select("kind", "measure", "percentile", ((F.col("below") < rank) & (rank <= F.col("upto"))).alias("within"))
