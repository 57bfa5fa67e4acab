"""Registration plates in recognised text: normalisation, first match, parts, and the optional table of known plates.

Recognition itself is a provider's work (``OcrProvider``): the default one reads a supplied
text column. Where no text was supplied, the check fails with low severity; text is never invented.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom import schema as S
from frameloom.config import Config

#: Blanks as browsers' regular expressions count them, spelled out since the JVM's class is narrower.
BLANK = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
# Fixed value: two letters, one or two digits, one or two letters, four digits; single blank or hyphen between.
PLATE = r"\b([A-Z]{2})[ -]?([0-9]{1,2})[ -]?([A-Z]{1,2})[ -]?([0-9]{4})\b"


class OcrProvider(Protocol):
    def text(self, images: DataFrame) -> DataFrame:
        """``images`` with the columns ``ocr_text`` and ``ocr_error`` (null where recognition worked)."""


class SuppliedText:
    """Takes the text from a column; a null text counts as a failed recognition."""

    def __init__(self, column: str = "ocr_text"):
        self.column = column

    def text(self, images: DataFrame) -> DataFrame:
        held = F.col(self.column) if self.column in images.columns else F.lit(None).cast("string")
        return images.withColumns({"ocr_text": held, "ocr_error": F.when(held.isNull(), "no recognised text was supplied")})


def normalized(text: Column) -> Column:
    """Upper case; all but letters, digits, blanks and hyphens become blanks; runs of blanks become one."""
    kept = F.regexp_replace(F.upper(text), f"(?:(?!{BLANK})[^A-Z0-9-])", " ")
    return F.trim(F.regexp_replace(kept, f"{BLANK}+", " "))


def parts(text: Column) -> Column:
    """Struct of the first plate in a normalised text; all fields null without one."""
    group = lambda i: F.regexp_extract(text, PLATE, i)
    found = group(0) != ""
    held = lambda c, n: F.when(found, c).alias(n)
    return F.struct(
        held(F.concat(group(1), F.lpad(group(2), 2, "0"), group(3), group(4)), "plate"),
        held(group(1), "state"), held(group(2), "rto"), held(group(3), "series"), held(group(4), "number"), held(group(0), "raw"),
    )


def known_parts(plate: Column) -> Column:
    """Parts of a known plate by fixed positions."""
    return F.struct(
        plate.alias("plate"), F.substring(plate, 1, 2).alias("state"), F.substring(plate, 3, 2).alias("rto"),
        F.substring(plate, 5, 2).alias("series"), F.expr("substring(known_plate, 7)").alias("number"), plate.alias("raw"),
    )


def with_known(images: DataFrame, known: DataFrame | None, sha_col: str = "sha256_hash") -> DataFrame:
    """Adds ``known_plate`` from a table (sha256_hash, plate). Which join strategy is used is left to its size."""
    if known is None:
        return images.withColumn("known_plate", F.lit(None).cast("string"))
    one = known.groupBy(F.lower("sha256_hash").alias("_sha")).agg(F.min("plate").alias("known_plate"))
    return images.join(one, F.lower(F.col(sha_col)) == F.col("_sha"), "left").drop("_sha")


def check(c: Config) -> Column:
    from frameloom.operators.checks import details, verdict

    known = F.col("known_plate")
    error = F.when(known.isNull(), F.col("ocr_error"))

    def judged(x: Column) -> Column:
        text, p = x["text"], x["p"]
        found = p["plate"].isNotNull()
        seen = details(extractedPlate=p["plate"], stateCode=p["state"], rtoCode=p["rto"], seriesCode=p["series"], uniqueNumber=p["number"], rawMatch=p["raw"])
        unseen = details(rawOcrTextLength=F.length("ocr_text"), normalizedSample=F.substring(text, 1, c.sample_length))
        return verdict(
            S.PLATE, error.isNull() & found, F.when(error.isNotNull(), "low").otherwise("medium"),
            F.when(error.isNotNull(), details(error=error)).when(found, seen).otherwise(unseen),
            F.when(error.isNotNull(), F.concat(F.lit("text recognition failed: "), error)).when(found, F.concat(F.lit("plate "), p["plate"])).otherwise("no plate in the text"),
        )

    # Bound by lambdas, so that the text is normalised and matched once a row and not at each use.
    read = F.transform(F.array(normalized(F.col("ocr_text"))), lambda t: F.struct(t.alias("text"), F.when(known.isNotNull(), known_parts(known)).otherwise(parts(t)).alias("p")))
    return F.get(F.transform(read, judged), F.lit(0))
