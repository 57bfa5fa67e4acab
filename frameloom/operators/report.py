"""Folding checks into one report per image. All within the row: nothing is grouped or shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.config import Config
from frameloom.functions.columns import half_up, severity_weight
from frameloom.operators.checks import REGISTRY, CheckSpec, column_of
from frameloom.schema import MAX_WEIGHT


def failed(checks: Column) -> Column:
    return F.filter(checks, lambda c: ~c["passed"])


def penalty(checks: Column) -> Column:
    return F.aggregate(failed(checks), F.lit(0), lambda acc, c: acc + severity_weight(c["severity"]))


def confidence(lost: Column, n: Column) -> Column:
    """1 without checks, else what is left of n checks of full weight, not below 0, to two places."""
    left = F.greatest(F.lit(0.0), F.lit(1.0) - lost / (n * MAX_WEIGHT).cast("double"))
    return F.when(n == 0, F.lit(1.0)).otherwise(half_up(left, 2))


def folded(checks: Column) -> Column:
    """Report struct of an array of check structs, in their order."""
    return F.struct(
        F.when(F.exists(checks, lambda c: ~c["passed"]), "flagged").otherwise("clean").alias("overall_status"),
        F.transform(failed(checks), lambda c: c["check"]).alias("issues_found"),
        checks.alias("checks"),
        confidence(penalty(checks), F.size(checks)).alias("confidence_score"),
    )


def analyze(features: DataFrame, config: Config, registry: tuple[CheckSpec, ...] = REGISTRY) -> DataFrame:
    """Adds ``analysis_result``. Extra specs may follow the standard ones; the score counts all of them."""
    checks = F.array(*[column_of(s, config) for s in registry])
    return features.withColumn("_checks", checks).withColumn("analysis_result", folded(F.col("_checks"))).drop("_checks")
