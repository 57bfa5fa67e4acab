"""The registered queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.hashes import usable_sql
from frameloom.llm import components, history, leaks, quantiles, seen_keys, skeleton, tokens
from frameloom.session import table


#: Batches that go through a persisted index or through sealed filters one by one in the incremental queries.
STEPS = 3


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen_keys.SeenKeys(table(spark, sf_dir, "image")).found()


def p1_error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen_keys.SeenKeys(table(spark, sf_dir, "image")).report()


def p1_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the report states without the filters' own answers, rounded for the comparison with SQL."""
    told = seen_keys.SeenKeys(table(spark, sf_dir, "image")).report()
    return told.select(F.col("batch_day").cast("string").alias("batch_day"), "probed_keys", "true_seen", "generations", F.round("wrong_rate_bound", 12).alias("wrong_rate_bound"))


def p1_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last days, each probed against sealed filters and then sealed itself."""
    return seen_keys.incremental(table(spark, sf_dir, "image"), STEPS)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.replay(table(spark, sf_dir, "image"))


def p2_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last days, each probed against a written index and appended to it."""
    return history.incremental(table(spark, sf_dir, "image"), STEPS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = components.image_links(table(spark, sf_dir, "image"), table(spark, sf_dir, "check_result"))
    groups = components.components(links)
    return groups.select(components.id_text(F.col("v")).alias("image_id"), components.id_text(F.col("label")).alias("group_id"))


def p5_daily_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.daily_sketches(table(spark, sf_dir, "image"))


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.image_percentiles(table(spark, sf_dir, "image")).withColumn("estimate", F.round("estimate", 6))


def p5_within_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.kept_promise(table(spark, sf_dir, "image"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p7_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(p7_found(spark, sf_dir), table(spark, sf_dir, "eval_item"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.look_alike_pairs(table(spark, sf_dir, "documents"))


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.look_alike_classes(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (p1_found, p1_error_report, p1_bounds, p1_incremental, p2_found, p2_incremental, p3_found, p5_daily_sketches, p5_percentiles, p5_within_error, p6_ids, p7_found, p7_leaked_items, p8_found, p8_classes)
    }


_SHA, _SIG = usable_sql("sha256_hash", 64), usable_sql("perceptual_hash", 16)

_BATCHES = f"""
  r AS (SELECT id, uploaded_at::DATE AS day, {_SHA} AS h, ('0x' || {_SIG})::UBIGINT AS s FROM image),
  hf AS (SELECT h, min(day) AS f FROM r WHERE h IS NOT NULL GROUP BY h),
  sf AS (SELECT s, min(day) AS f FROM r WHERE s IS NOT NULL GROUP BY s),
  near AS (SELECT a.s, min(b.f) AS f FROM sf a JOIN sf b ON bit_count(xor(a.s, b.s)) <= 5 GROUP BY a.s),
  told AS (SELECT r.id AS image_id, r.day, CASE WHEN hf.f < r.day THEN 'exact' WHEN near.f < r.day THEN 'near' END AS match_kind
           FROM r LEFT JOIN hf USING (h) LEFT JOIN near USING (s))"""

_LINKS = """
  d AS (SELECT i.id AS image_id, c.details_json AS j FROM image i, unnest(i.analysis_result.checks) AS t(c) WHERE c."check" = 'duplicate_detection'
        UNION ALL SELECT image_id, details_json FROM check_result WHERE check_name = 'duplicate_detection'),
  one AS (SELECT image_id, CASE WHEN json_valid(j) THEN j::JSON END AS j FROM d),
  two AS (SELECT image_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN (j->>'$')::JSON END ELSE j END AS j FROM one WHERE j IS NOT NULL),
  objs AS (SELECT image_id, j FROM two WHERE json_type(j) = 'OBJECT'
           UNION ALL SELECT image_id, unnest(from_json(j, '["JSON"]')) FROM two WHERE json_type(j) = 'ARRAY'),
  named AS (SELECT image_id, coalesce(j->>'$.matchedImageId', j->>'$.matched_image_id', j->>'$.match.imageId', j->>'$.matchedImage.id') AS m
            FROM objs WHERE json_type(j) = 'OBJECT' AND j->>'$.matchType' IN ('exact', 'near_duplicate')),
  ends AS (SELECT replace(lower(image_id), '-', '') AS a,
                  replace(regexp_extract(lower(m), '[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}'), '-', '') AS b FROM named),
  ids AS (SELECT id, replace(id, '-', '') AS v FROM image),
  e AS (SELECT DISTINCT x.id AS a, y.id AS b FROM ends JOIN ids x ON ends.a = x.v JOIN ids y ON ends.b = y.v WHERE x.id <> y.id),
  both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  reach AS (SELECT DISTINCT a AS v, a AS w FROM both_ways UNION SELECT reach.v, both_ways.b FROM reach JOIN both_ways ON reach.w = both_ways.a)"""

_WIDTH = math.log(quantiles.gamma_of(quantiles.RELATIVE_ERROR))
_KIND = r"lower(regexp_replace(split_part(mime_type, ';', 1), '\s+', '', 'g'))"
_MEASURES = f"""
  k AS (SELECT uploaded_at::DATE::VARCHAR AS day, CASE WHEN coalesce({_KIND}, '') = '' THEN 'unknown' WHEN {_KIND} IN ('image/jpg', 'image/pjpeg') THEN 'image/jpeg' ELSE {_KIND} END AS kind,
               size_bytes, analysis_result.confidence_score AS score FROM image),
  m AS (SELECT day, kind, 'size_bytes' AS measure, size_bytes::DOUBLE AS x FROM k WHERE size_bytes >= 1 AND size_bytes < 2147483647
        UNION ALL SELECT day, kind, 'confidence_score', score FROM k WHERE NOT isnan(score) AND score BETWEEN 0 AND 1),
  b AS (SELECT day, kind, measure, sign(x)::INTEGER AS sign, CASE WHEN x = 0 THEN 0 ELSE ceil(ln(abs(x)) / {_WIDTH!r})::INTEGER END AS bucket, count(*) AS n
        FROM m GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    """SQL where it expresses the operator; the others are tested against brute force in tests/llm."""
    gamma = quantiles.gamma_of(quantiles.RELATIVE_ERROR)
    points = ", ".join(f"({p}::DOUBLE)" for p in quantiles.PERCENTILES)
    return {
        "p1_found": f"""WITH r AS (SELECT id, row_number() OVER (PARTITION BY {_SHA} ORDER BY uploaded_at, id) AS k FROM image WHERE {_SHA} IS NOT NULL)
            SELECT id AS image_id FROM r WHERE k > 1""",
        "p1_bounds": f"""WITH r AS (SELECT uploaded_at::DATE AS day, {_SHA} AS h FROM image WHERE {_SHA} IS NOT NULL), k AS (SELECT DISTINCT day, h FROM r), f AS (SELECT h, min(day) AS first FROM k GROUP BY h),
            d AS (SELECT day, count(*) AS probed_keys, count(*) FILTER (first < day) AS true_seen, count(*) FILTER (first = day) AS new_keys FROM k JOIN f USING (h) GROUP BY day)
            SELECT day::VARCHAR AS batch_day, probed_keys, true_seen, (row_number() OVER (ORDER BY day) - 1)::INTEGER AS generations,
                   round(1 - pow(1 - pow(2.0::DOUBLE, -16), row_number() OVER (ORDER BY day) - 1) + coalesce(sum(new_keys) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / pow(2.0::DOUBLE, 64), 12) AS wrong_rate_bound FROM d""",
        "p1_incremental": f"""WITH r AS (SELECT id, uploaded_at::DATE AS day, CASE WHEN {_SHA} IS NOT NULL THEN row_number() OVER (PARTITION BY {_SHA} ORDER BY uploaded_at, id) END AS k FROM image)
            SELECT id AS image_id FROM r WHERE k > 1 AND day IN (SELECT DISTINCT day FROM r ORDER BY day DESC LIMIT {STEPS})""",
        "p2_found": f"WITH {_BATCHES} SELECT image_id, match_kind FROM told WHERE match_kind IS NOT NULL",
        "p2_incremental": f"WITH {_BATCHES} SELECT image_id, match_kind FROM told WHERE match_kind IS NOT NULL AND day IN (SELECT DISTINCT day FROM r ORDER BY day DESC LIMIT {STEPS})",
        "p3_found": f"WITH RECURSIVE {_LINKS} SELECT v AS image_id, min(w) AS group_id FROM reach GROUP BY v",
        "p5_daily_sketches": f"WITH {_MEASURES} SELECT * FROM b",
        "p5_within_error": f"""WITH {_MEASURES}, o AS (SELECT kind, measure, x, row_number() OVER (PARTITION BY kind, measure ORDER BY x) AS k, count(*) OVER (PARTITION BY kind, measure) AS total FROM m),
            t AS (SELECT kind, measure, percentile, x, {2.0 / (gamma + 1)!r}::DOUBLE * pow({gamma!r}::DOUBLE, ceil(ln(x) / {_WIDTH!r})) AS estimate FROM o, (VALUES {points}) AS p(percentile) WHERE k = greatest(ceil(round(percentile * total, 6)), 1))
            SELECT kind, measure, percentile, CASE WHEN x = 0 THEN TRUE ELSE abs(estimate - x) <= {quantiles.RELATIVE_ERROR}::DOUBLE * x * (1 + 1e-9) END AS within FROM t""",
        "p5_percentiles": f"""WITH {_MEASURES}, s AS (SELECT kind, measure, sign, bucket, sum(n) AS n FROM b GROUP BY ALL),
            c AS (SELECT *, sum(n) OVER (PARTITION BY kind, measure ORDER BY sign, sign * bucket) AS upto, sum(n) OVER (PARTITION BY kind, measure) AS total FROM s),
            q AS (SELECT *, greatest(ceil(round(percentile * total, 6)), 1) AS rank FROM c, (VALUES {points}) AS p(percentile))
            SELECT kind, measure, percentile, total::BIGINT AS n_values, round(sign * {2.0 / (gamma + 1)!r}::DOUBLE * pow({gamma!r}::DOUBLE, bucket), 6) AS estimate,
                   {quantiles.RELATIVE_ERROR}::DOUBLE AS relative_error FROM q WHERE upto >= rank AND upto - n < rank""",
    }
