"""The registered queries of the core and the SQL they are compared with.

Relational operators run over the domain tables. Pixel operators have no images here: the 64 values of an
``embeddings`` row stand in for an 8x8 grey grid, which tests the arithmetic only; images themselves
are tested on generated files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom import api, dashboard
from frameloom import schema as S
from frameloom.config import Config
from frameloom.functions import columns as C
from frameloom.functions.hashes import usable_sql
from frameloom.operators import checks, duplicates, lifecycle, plates, report
from frameloom.operators.nested import NestedReports
from frameloom.session import table
from frameloom.sources import ingest

CONFIG = Config()
#: Stand-in distance: the closest of the grids' fingerprints are farther apart than copies of images.
GRID = CONFIG.with_(near_distance=20)
NOW = "2019-03-29 00:00:00"

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# -- nested reports ---------------------------------------------------------------------------------

_DETAILS = """
  e AS (SELECT id AS image_id, (generate_subscripts(analysis_result.checks, 1) - 1)::INTEGER AS check_pos, unnest(analysis_result.checks).details_json AS j FROM image),
  one AS (SELECT image_id, check_pos, j::JSON AS j FROM e WHERE json_valid(j)),
  two AS (SELECT image_id, check_pos, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN (j->>'$')::JSON END ELSE j END AS j FROM one),
  tree AS (SELECT image_id, check_pos, regexp_replace(t.fullkey, '^\\$\\.?', '') AS path, t.type, t.atom
           FROM two, json_tree(two.j) AS t WHERE json_type(two.j) IN ('OBJECT', 'ARRAY') AND t.type NOT IN ('OBJECT', 'ARRAY'))"""


@query(f"WITH {_DETAILS} SELECT image_id, check_pos, path FROM tree")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NestedReports(table(spark, sf_dir, "image")).paths()


@query(f"""WITH {_DETAILS} SELECT image_id, check_pos, path,
  CASE WHEN type = 'VARCHAR' THEN 'string' WHEN type = 'BOOLEAN' THEN 'boolean' WHEN type = 'NULL' THEN 'null' ELSE 'number' END AS value_type,
  CASE WHEN type IN ('VARCHAR', 'BOOLEAN') THEN atom->>'$' END AS value FROM tree""")
def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = NestedReports(table(spark, sf_dir, "image")).values()
    # Texts of numbers differ between engines in how they are written, not in value.
    return made.withColumn("value", F.when(F.col("value_type").isin("string", "boolean"), F.col("value")))


@query("""SELECT id AS image_id, analysis_result.overall_status AS overall_status, coalesce(len(analysis_result.issues_found), 0)::INTEGER AS n_issues,
  len(analysis_result.checks)::INTEGER AS n_checks, CASE WHEN NOT isnan(analysis_result.confidence_score) THEN analysis_result.confidence_score END AS confidence_score FROM image WHERE analysis_result IS NOT NULL""")
def p4_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NestedReports(table(spark, sf_dir, "image")).reports()


@query("""WITH e AS (SELECT id AS image_id, (generate_subscripts(analysis_result.checks, 1) - 1)::INTEGER AS check_pos, unnest(analysis_result.checks) AS c FROM image)
  SELECT image_id, check_pos, c."check" AS check_name, c.passed AS passed, c.severity AS severity, c.message AS message FROM e WHERE c IS NOT NULL""")
def p4_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NestedReports(table(spark, sf_dir, "image")).checks()


@query("""WITH RECURSIVE e AS (SELECT id AS image_id, (generate_subscripts(analysis_result.checks, 1) - 1)::INTEGER AS check_pos, unnest(analysis_result.checks).details_json AS j FROM image),
  one AS (SELECT j::JSON AS j FROM e WHERE json_valid(j)),
  two AS (SELECT CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN (j->>'$')::JSON END ELSE j END AS j FROM one),
  texts AS (SELECT j::VARCHAR AS j, count(*) AS n FROM two WHERE json_type(j) IN ('OBJECT', 'ARRAY') GROUP BY 1),
  node AS (SELECT row_number() OVER () AS root, j, n, TRUE AS top FROM texts),
  down AS (SELECT root, j::JSON AS j, n, TRUE AS top FROM node
           UNION ALL SELECT down.root, x.value::JSON, down.n, FALSE FROM down, json_each(down.j) AS x WHERE x.type IN ('OBJECT', 'ARRAY')),
  made AS (SELECT DISTINCT j::VARCHAR AS j FROM down),
  form AS (SELECT made.j, json_type(made.j::JSON) AS kind, json_array_length(CASE WHEN json_type(made.j::JSON) = 'ARRAY' THEN made.j ELSE json_keys(made.j::JSON)::JSON END) AS n_children,
                  (SELECT string_agg(concat(t.fullkey, chr(1), t.type, chr(1), CASE WHEN t.type IN ('OBJECT', 'ARRAY') THEN '' WHEN t.type = 'DOUBLE' THEN t.atom::DOUBLE::VARCHAR ELSE coalesce(t.atom::VARCHAR, '') END), chr(2) ORDER BY t.fullkey) FROM json_tree(made.j::JSON) AS t) AS canon FROM made),
  uses AS (SELECT f.canon, sum(d.n) FILTER (d.top) AS details FROM down d JOIN form f ON d.j::VARCHAR = f.j GROUP BY 1)
  SELECT CASE any_value(kind) WHEN 'OBJECT' THEN 'object' ELSE 'list' END AS kind, any_value(n_children)::INTEGER AS n_children, coalesce(any_value(uses.details), 0)::BIGINT AS details FROM form JOIN uses USING (canon) GROUP BY canon""")
def p4_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct subtree once, with the number of details that are it; identities themselves are no SQL's."""
    made = NestedReports(table(spark, sf_dir, "image"))
    uses = made.details().groupBy("node").agg(F.count(F.lit(1)).alias("details"))
    return made.objects().join(uses, "node", "left").select("kind", "n_children", F.coalesce("details", F.lit(0)).alias("details"))


# -- reports, checks, scores ------------------------------------------------------------------------

_KEPT = "list_filter(analysis_result.checks, lambda c: c IS NOT NULL)"
_PENALTY = "coalesce(list_sum(list_transform(list_filter(k, lambda c: NOT c.passed), lambda c: CASE c.severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END)), 0)"
_REPORTS = f"""
  r AS (SELECT id, {_KEPT} AS k FROM image WHERE analysis_result.checks IS NOT NULL),
  f AS (SELECT id, CASE WHEN len(list_filter(k, lambda c: NOT c.passed)) > 0 THEN 'flagged' ELSE 'clean' END AS overall_status,
               list_transform(list_filter(k, lambda c: NOT c.passed), lambda c: c."check") AS issues_found, k,
               CASE WHEN len(k) = 0 THEN 1.0::DOUBLE ELSE floor(greatest(0.0::DOUBLE, 1.0::DOUBLE - {_PENALTY} / (len(k) * 3)::DOUBLE) * 100 + 0.5) / 100 END AS confidence_score FROM r)"""


def _refolded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "image").where(F.col("analysis_result.checks").isNotNull())
    kept = rows.select("id", F.filter("analysis_result.checks", lambda c: c.isNotNull()).alias("k"))
    return kept.select("id", report.folded(F.col("k")).alias("r")).select("id", "r.*")


@query(f"WITH {_REPORTS} SELECT id, overall_status, issues_found, confidence_score FROM f")
def inspection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports folded anew from their checks: verdict, issues in order, weighted score."""
    return _refolded(spark, sf_dir).select("id", "overall_status", "issues_found", "confidence_score")


@query(f"WITH {_REPORTS}, i AS (SELECT unnest(issues_found) AS issue FROM f) SELECT issue, count(*) AS images FROM i GROUP BY issue")
def issue_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refolded(spark, sf_dir).select(F.explode("issues_found").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("images"))


@query(f"""WITH {_REPORTS}, b AS (SELECT CASE WHEN floor(confidence_score * 100 + 0.5) >= 80 THEN 'pass' WHEN floor(confidence_score * 100 + 0.5) >= 50 THEN 'warn' ELSE 'fail' END AS band FROM f)
  SELECT band, count(*) AS images FROM b GROUP BY band""")
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refolded(spark, sf_dir).groupBy(C.confidence_band(F.col("confidence_score")).alias("band")).agg(F.count(F.lit(1)).alias("images"))


# -- pixel arithmetic on stand-in grids -------------------------------------------------------------

_GRID = "g AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(0, least(255, floor((x::DOUBLE + 1) * 127.5::DOUBLE)))::INTEGER) AS p FROM embeddings)"
_BITS = "b AS (SELECT vec_id, p, list_transform(p, lambda x: CASE WHEN x * 64 >= list_sum(p) THEN 1 ELSE 0 END) AS bits FROM g)"
_HALVES = """h AS (SELECT vec_id, list_reduce(list_transform(bits[1:32], lambda b: b::BIGINT), lambda a, b: a * 2 + b) AS hi,
  list_reduce(list_transform(bits[33:64], lambda b: b::BIGINT), lambda a, b: a * 2 + b) AS lo FROM b)"""


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixel = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1) * 127.5))).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", pixel).alias("thumb8x8"))


def grid_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ingest.with_fingerprint(grids(spark, sf_dir))
    return made.select(F.col("vec_id").alias("id"), "ahash_hi", "ahash_lo", "perceptual_hash", F.col("vec_id").alias("uploaded_at"))


@query(f"WITH {_GRID}, {_BITS}, {_HALVES} SELECT vec_id AS id, hi AS ahash_hi, lo AS ahash_lo, lower(printf('%08x%08x', hi, lo)) AS perceptual_hash FROM h")
def ahash_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_fingerprints(spark, sf_dir).drop("uploaded_at")


def _at(cell: str) -> str:
    return f"p[{cell} + 1]"


_LAPLACE = "list_transform(range(64), lambda i: greatest(0, least(255, p[CASE WHEN i < 8 THEN i ELSE i - 8 END + 1] + p[CASE WHEN i >= 56 THEN i ELSE i + 8 END + 1] + p[CASE WHEN i % 8 = 0 THEN i ELSE i - 1 END + 1] + p[CASE WHEN i % 8 = 7 THEN i ELSE i + 1 END + 1] - 4 * p[i + 1])))"


@query(f"""WITH {_GRID}, l AS (SELECT vec_id, {_LAPLACE} AS r FROM g), v AS (SELECT vec_id, (64 * list_sum(list_transform(r, lambda x: x::BIGINT * x)) - list_sum(r) * list_sum(r))::BIGINT / 4096.0::DOUBLE AS variance FROM l)
  SELECT vec_id, floor(variance * 100 + 0.5) / 100 AS variance, variance >= 100 AS passed, CASE WHEN variance >= 100 THEN 'none' ELSE 'high' END AS severity FROM v""")
def laplacian_blur_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blur check on the clipped Laplacian of the grids, in exact integers."""
    made = grids(spark, sf_dir).withColumns({"laplacian_var": C.laplacian_spread(F.col("thumb8x8"), 8) / 4096.0, "resized_to": F.lit("8x8")}).withColumn("c", checks.blur(CONFIG))
    return made.select("vec_id", F.get_json_object("c.details_json", "$.laplacianVariance").cast("double").alias("variance"), "c.passed", "c.severity")


@query(f"""WITH {_GRID}, m AS (SELECT vec_id, list_sum(p)::BIGINT / 64.0::DOUBLE AS mean FROM g)
  SELECT vec_id, floor(mean * 100 + 0.5) / 100 AS mean_brightness, mean >= 60 AND mean <= 200 AS passed, CASE WHEN mean < 60 OR mean > 200 THEN 'medium' ELSE 'none' END AS severity FROM m""")
def brightness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate("thumb8x8", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    made = grids(spark, sf_dir).withColumn("mean_red", total / 64.0).withColumn("c", checks.brightness(CONFIG))
    return made.select("vec_id", C.half_up(F.col("mean_red"), 2).alias("mean_brightness"), "c.passed", "c.severity")


@query(f"""WITH {_GRID}, q AS (SELECT vec_id, list_transform(p, lambda x: abs(x - least(255, ((x + 8) // 17) * 17))) AS d FROM g),
  s AS (SELECT vec_id, list_sum(d)::BIGINT AS total, list_max(d) AS most FROM q)
  SELECT vec_id, floor(total / 64.0::DOUBLE * 1000 + 0.5) / 1000 AS mean_error, most AS max_error, CASE WHEN total = 0 THEN 0 ELSE floor(most / (total / 64.0::DOUBLE) * 100 + 0.5) / 100 END::DOUBLE AS spike_ratio,
         CASE WHEN total = 0 THEN TRUE ELSE most / (total / 64.0::DOUBLE) <= 40 END AS passed FROM s""")
def error_level_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spike rule on the error of a coarse quantisation in place of a recompression."""
    coarse = lambda x: F.least(F.lit(255), F.floor((x + 8) / 17) * 17)
    made = grids(spark, sf_dir).withColumn("d", F.transform("thumb8x8", lambda x: F.abs(x - coarse(x)).cast("int")))
    made = made.withColumns({"ela_sum": F.aggregate("d", F.lit(0).cast("bigint"), lambda acc, x: acc + x), "ela_n": F.lit(64), "ela_max": F.array_max("d"), "format": F.lit("jpeg")})
    made = made.withColumn("c", checks.tampering(CONFIG.with_(profile="documented")))
    got = lambda n, kind: F.get_json_object("c.details_json", f"$.{n}").cast(kind)
    return made.select("vec_id", got("meanErrorLevel", "double").alias("mean_error"), got("maxErrorLevel", "int").alias("max_error"), got("spikeRatio", "double").alias("spike_ratio"), "c.passed")


@query(f"""WITH {_GRID}, m AS (SELECT vec_id, list_sum(p)::BIGINT / 64.0::DOUBLE AS mean FROM g),
  c AS (SELECT vec_id, mean < 60 OR mean > 200 AS light, 200 + vec_id % 700 < 400 OR 150 + vec_id % 500 < 300 AS small FROM m)
  SELECT vec_id AS id, CASE WHEN light OR small THEN 'flagged' ELSE 'clean' END AS overall_status,
         list_filter([CASE WHEN light THEN 'brightness_analysis' END, CASE WHEN small THEN 'dimension_validation' END], lambda x: x IS NOT NULL) AS issues_found,
         floor((1 - (CASE WHEN light THEN 2 ELSE 0 END + CASE WHEN small THEN 3 ELSE 0 END) / 6.0::DOUBLE) * 100 + 0.5) / 100 AS confidence_score FROM c""")
def analyzed_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks from the registry, run on feature rows and folded."""
    total = F.aggregate("thumb8x8", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    none = F.lit(None).cast("string")
    rows = grids(spark, sf_dir).select(
        F.col("vec_id").alias("id"), (total / 64.0).alias("mean_red"), none.alias("pixel_error"), none.alias("header_error"),
        (F.col("vec_id") % 700 + 200).cast("int").alias("width"), (F.col("vec_id") % 500 + 150).cast("int").alias("height"),
    )
    chosen = tuple(s for s in checks.REGISTRY if s.name in (S.BRIGHTNESS, S.DIMENSIONS))
    return report.analyze(rows, CONFIG, chosen).select("id", "analysis_result.overall_status", "analysis_result.issues_found", "analysis_result.confidence_score")


# -- duplicates -------------------------------------------------------------------------------------

# Usable hashes, and fingerprints from the hash text where the halves are missing.
_HASHED = f"""u AS (SELECT id, uploaded_at, {usable_sql('sha256_hash', 64)} AS sha, {usable_sql('perceptual_hash', 16)} AS dig, ahash_hi, ahash_lo FROM image),
  fp AS (SELECT id, uploaded_at, CASE WHEN ahash_hi IS NOT NULL AND ahash_lo IS NOT NULL THEN ahash_hi ELSE ('0x' || substring(dig, 1, 8))::BIGINT END AS ahash_hi,
         CASE WHEN ahash_hi IS NOT NULL AND ahash_lo IS NOT NULL THEN ahash_lo ELSE ('0x' || substring(dig, 9, 8))::BIGINT END AS ahash_lo FROM u)"""
_EXACT = f"""{_HASHED}, x AS (SELECT a.id, first(b.id ORDER BY b.uploaded_at, b.id) AS matched_id, min(b.uploaded_at) AS matched_at
  FROM u a JOIN u b ON a.sha = b.sha AND a.id <> b.id GROUP BY a.id)"""
_DIST = "bit_count(xor({0}.ahash_hi, {1}.ahash_hi)) + bit_count(xor({0}.ahash_lo, {1}.ahash_lo))"


def _near_sql(source: str, window: int, limit: int) -> str:
    d = _DIST.format("a", "b")
    return f"""hashed AS (SELECT id, ahash_hi, ahash_lo, row_number() OVER (ORDER BY uploaded_at DESC, id DESC) AS rank FROM {source} WHERE ahash_hi IS NOT NULL AND ahash_lo IS NOT NULL),
  pairs AS (SELECT a.id, b.id AS matched_id, ({d})::INTEGER AS distance, b.rank FROM hashed a JOIN hashed b ON a.id <> b.id AND b.rank <= {window} + CASE WHEN a.rank <= {window} THEN 1 ELSE 0 END),
  n AS (SELECT id, matched_id, distance FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, rank) = 1),
  near AS (SELECT * FROM n WHERE distance <= {limit})"""


@query(f"WITH {_EXACT} SELECT * FROM x")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.exact_matches(table(spark, sf_dir, "image"))


@query(f"WITH {_HASHED}, {_near_sql('fp', CONFIG.near_window, CONFIG.near_distance)} SELECT * FROM near")
def near_duplicates_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.near_in_window(table(spark, sf_dir, "image"), CONFIG)


@query(f"WITH {_GRID}, {_BITS}, {_HALVES}, fp AS (SELECT vec_id AS id, hi AS ahash_hi, lo AS ahash_lo, vec_id AS uploaded_at FROM h), {_near_sql('fp', CONFIG.near_window, 20)} SELECT * FROM near")
def near_grids_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.near_in_window(grid_fingerprints(spark, sf_dir), GRID)


@query(f"""WITH {_HASHED}, s AS (SELECT id, ahash_hi, ahash_lo, row_number() OVER (ORDER BY uploaded_at, id) AS seq FROM fp WHERE ahash_hi IS NOT NULL AND ahash_lo IS NOT NULL),
  p AS (SELECT a.id, b.id AS matched_id, ({_DIST.format('a', 'b')})::INTEGER AS distance, b.seq FROM s a JOIN s b ON b.seq < a.seq AND b.seq >= a.seq - {CONFIG.near_window})
  SELECT id, matched_id, distance FROM p WHERE distance <= {CONFIG.near_distance} QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, seq DESC) = 1""")
def near_duplicates_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.near_before_upload(table(spark, sf_dir, "image"), CONFIG)


@query(f"""WITH {_HASHED}, f AS (SELECT ahash_hi, ahash_lo, min(id) AS id FROM fp WHERE ahash_hi IS NOT NULL AND ahash_lo IS NOT NULL GROUP BY ALL)
  SELECT a.id AS id_a, b.id AS id_b, ({_DIST.format('a', 'b')})::INTEGER AS distance FROM f a JOIN f b ON a.id < b.id AND {_DIST.format('a', 'b')} <= {CONFIG.near_distance}""")
def near_duplicates_banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.near_pairs(table(spark, sf_dir, "image"), CONFIG.near_distance)


@query(f"WITH {_HASHED} SELECT min(id) AS class_id, count(*) AS members FROM fp WHERE ahash_hi IS NOT NULL AND ahash_lo IS NOT NULL GROUP BY ahash_hi, ahash_lo")
def fingerprint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.fingerprint_classes(table(spark, sf_dir, "image")).select("class_id", "members")


@query(f"""WITH {_EXACT}, {_near_sql('fp', CONFIG.near_window, CONFIG.near_distance)}
  SELECT id, 'exact' AS match_type, matched_id, matched_at, NULL::INTEGER AS distance FROM x
  UNION ALL SELECT id, 'near_duplicate', matched_id, NULL, distance FROM near WHERE id NOT IN (SELECT id FROM x)""")
def duplicate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.verdicts(table(spark, sf_dir, "image"), CONFIG)


# -- header-based checks on stand-in sizes ----------------------------------------------------------

@query("""WITH s AS (SELECT p_partkey, p_size * 20 AS w, (p_partkey % 50 * 12)::INTEGER AS h FROM part)
  SELECT p_partkey, w >= 400 AND h >= 300 AS passed, CASE WHEN w >= 400 AND h >= 300 THEN 'none' ELSE 'high' END AS severity FROM s""")
def dimension_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 20).alias("width"), (F.col("p_partkey") % 50 * 12).cast("int").alias("height"))
    return sized.withColumn("c", checks.dimensions(CONFIG)).select("p_partkey", "c.passed", "c.severity")


_SCREENS = ", ".join(f"({a}, {b})" for a, b in S.SCREENS)


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, CASE l_orderkey % 4 WHEN 0 THEN 1080 WHEN 1 THEN 1920 WHEN 2 THEN 750 ELSE 1000 END AS w,
    CASE l_partkey % 4 WHEN 0 THEN 1920 WHEN 1 THEN 1334 WHEN 2 THEN 1080 ELSE 2400 END AS h, CASE l_suppkey % 3 WHEN 0 THEN 'png' ELSE 'jpeg' END AS f, l_linenumber % 3 = 0 AS cam, l_linenumber % 5 = 0 AS soft FROM lineitem),
  m AS (SELECT *, EXISTS (SELECT 1 FROM (VALUES {_SCREENS}) AS t(a, b) WHERE a = least(w, h) AND b = greatest(w, h)) AS screen FROM s)
  SELECT l_orderkey, l_linenumber, NOT ((screen AND NOT cam) OR soft) AS passed, CASE WHEN screen AND NOT cam THEN 'high' WHEN soft THEN 'medium' ELSE 'none' END AS severity,
         (screen::INTEGER + (f = 'png' AND NOT cam)::INTEGER + (NOT cam)::INTEGER) AS signals FROM m""")
def screen_resolution_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda c, n, values: F.element_at(F.array(*map(F.lit, values)), (F.col(c) % n + 1).cast("int"))
    none = F.lit(None).cast("string")
    camera, edited = F.when(F.col("l_linenumber") % 3 == 0, "Orvex"), F.when(F.col("l_linenumber") % 5 == 0, "GIMP 2.10")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", pick("l_orderkey", 4, (1080, 1920, 750, 1000)).alias("width"), pick("l_partkey", 4, (1920, 1334, 1080, 2400)).alias("height"),
        pick("l_suppkey", 3, ("png", "jpeg", "jpeg")).alias("format"), F.struct(camera.alias("make"), none.alias("model"), none.alias("captured_at"), edited.alias("software")).alias("exif"),
    )
    c = rows.withColumn("c", checks.screenshot(CONFIG))
    return c.select("l_orderkey", "l_linenumber", "c.passed", "c.severity", F.get_json_object("c.details_json", "$.screenshotSignalCount").cast("int").alias("signals"))


@query("""WITH e AS (SELECT event_id, (props->>'$.k')::INTEGER AS k, event_type FROM events),
  m AS (SELECT event_id, CASE WHEN event_type = 'click' THEN 'png' ELSE 'jpeg' END AS f, CASE WHEN k % 3 = 0 THEN 0 ELSE k END AS tags, k % 7 = 0 AS gps FROM e)
  SELECT event_id, NOT (f = 'jpeg' AND tags = 0) AS passed, tags > 0 AS has_exif, gps AS has_gps FROM m""")
def metadata_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") == "click", "png").otherwise("jpeg").alias("format"),
        F.struct(none.alias("make"), none.alias("model"), none.alias("captured_at"), F.when(k % 7 == 0, F.lit(1.5)).alias("gps_latitude"), F.when(k % 3 == 0, 0).otherwise(k).alias("tag_count")).alias("exif"),
    )
    c = rows.withColumn("c", checks.metadata(CONFIG))
    got = lambda n: F.get_json_object("c.details_json", f"$.{n}").cast("boolean")
    return c.select("event_id", "c.passed", got("hasExif").alias("has_exif"), got("hasGps").alias("has_gps"))


_PLATE_TEXT = """concat(CASE o_orderkey % 7 WHEN 0 THEN 'x ' ELSE '' END, chr((97 + o_custkey % 26)::INTEGER), chr((65 + o_orderkey % 26)::INTEGER), sep, CASE WHEN o_custkey % 3 = 0 THEN (o_custkey % 10)::VARCHAR ELSE lpad((o_custkey % 100)::VARCHAR, 2, '0') END,
  sep, 'M', CASE WHEN o_orderkey % 2 = 0 THEN 'h' ELSE '' END, sep, lpad((o_orderkey % 10000)::VARCHAR, 4, '0'), CASE WHEN o_orderkey % 11 = 0 THEN '9' ELSE '' END)"""


@query(f"""WITH t AS (SELECT o_orderkey, o_custkey, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN '-' WHEN 3 THEN '.' ELSE chr(10) END AS sep FROM orders),
  u AS (SELECT o_orderkey, trim(regexp_replace(regexp_replace(upper({_PLATE_TEXT}), '[^A-Z0-9\\s-]', ' ', 'g'), '\\s+', ' ', 'g')) AS n FROM t),
  m AS (SELECT o_orderkey, regexp_extract(n, '{plates.PLATE}', ['raw', 's', 'r', 'c', 'd']) AS g, regexp_extract(n, '{plates.PLATE}', 0) AS raw,
        regexp_extract(n, '{plates.PLATE}', 1) AS s, regexp_extract(n, '{plates.PLATE}', 2) AS r, regexp_extract(n, '{plates.PLATE}', 3) AS c, regexp_extract(n, '{plates.PLATE}', 4) AS d FROM u)
  SELECT o_orderkey, raw <> '' AS passed, CASE WHEN raw <> '' THEN concat(s, lpad(r, 2, '0'), c, d) END AS plate, CASE WHEN raw <> '' THEN r END AS rto, CASE WHEN raw <> '' THEN raw END AS raw FROM m""".replace("regexp_extract(n, '" + plates.PLATE + "', ['raw', 's', 'r', 'c', 'd']) AS g, ", ""))
def plate_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda col, n, values: F.element_at(F.array(*map(F.lit, values)), (col % n + 1).cast("int"))
    sep = pick(o, 5, ("", " ", "-", ".", "\n"))
    text = F.concat(
        F.when(o % 7 == 0, "x ").otherwise(""), F.chr(c % 26 + 97), F.chr(o % 26 + 65), sep, F.when(c % 3 == 0, (c % 10).cast("string")).otherwise(F.lpad((c % 100).cast("string"), 2, "0")),
        sep, F.lit("M"), F.when(o % 2 == 0, "h").otherwise(""), sep, F.lpad((o % 10000).cast("string"), 4, "0"), F.when(o % 11 == 0, "9").otherwise(""),
    )
    rows = plates.SuppliedText().text(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("ocr_text"))).withColumn("known_plate", F.lit(None).cast("string"))
    made = rows.withColumn("c", plates.check(CONFIG))
    got = lambda n: F.get_json_object("c.details_json", f"$.{n}")
    return made.select("o_orderkey", "c.passed", got("extractedPlate").alias("plate"), got("rtoCode").alias("rto"), got("rawMatch").alias("raw"))


# -- listing, state, lifecycle ----------------------------------------------------------------------

@query("""SELECT id, original_name, stored_filename, mime_type, size_bytes, status, attempts, uploaded_at, processed_at, failure_reason, analysis_result.overall_status AS overall_status
  FROM image WHERE status = 'completed' ORDER BY uploaded_at DESC, id LIMIT 100 OFFSET 40""")
def list_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, skip = api.page_bounds("500", "40", CONFIG)
    rows = api.listed(table(spark, sf_dir, "image"), S.COMPLETED).orderBy(F.desc("uploaded_at"), "id").offset(skip).limit(n)
    return rows.withColumn("overall_status", F.col("analysis_result.overall_status")).drop("analysis_result")


@query("SELECT status, count(*) AS images FROM image GROUP BY status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.by_status(table(spark, sf_dir, "image"))


@query("""SELECT count(*) AS shown, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'completed' AND analysis_result.overall_status = 'flagged') AS flagged,
  count(*) FILTER (status IN ('pending', 'processing')) AS active FROM image""")
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.counts(table(spark, sf_dir, "image"))


@query("SELECT id, status, attempts, uploaded_at FROM image WHERE status IN ('pending', 'processing')")
def queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.queue(table(spark, sf_dir, "image"))


@query("SELECT id, status, attempts, uploaded_at, processing_started_at, processed_at, CASE WHEN status = 'failed' THEN failure_reason END AS failure_reason FROM image")
def status_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "image").select(*api.status_columns())


@query("SELECT id, status, processed_at, CASE WHEN NOT isnan(analysis_result.confidence_score) THEN analysis_result.confidence_score END AS confidence_score FROM image WHERE status = 'completed'")
def results_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.completed(table(spark, sf_dir, "image"))


@query("SELECT id, status, attempts, failure_reason FROM image WHERE status = 'failed'")
def failure_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.failed(table(spark, sf_dir, "image"))


def _first(images: DataFrame, status: str) -> str:
    return images.where(F.col("status") == status).agg(F.min("id")).first()[0]


@query("""SELECT count(*) OVER () AS total, id, status FROM image ORDER BY uploaded_at DESC, id LIMIT 20 OFFSET 20""")
def list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page with the total, by the listing itself."""
    page = api.list_images(table(spark, sf_dir, "image"), None, "20", "20", CONFIG)
    return page.items.select(F.lit(page.total).cast("bigint").alias("total"), "id", "status")


@query("""WITH p AS (SELECT * FROM image ORDER BY uploaded_at DESC, id LIMIT 20)
  SELECT count(*) AS shown, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'completed' AND analysis_result.overall_status = 'flagged') AS flagged,
  count(*) FILTER (status IN ('pending', 'processing')) AS active FROM p""")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of what one page shows."""
    return dashboard.counts(api.list_images(table(spark, sf_dir, "image"), config=CONFIG).items)


@query("SELECT id, status, attempts, uploaded_at, processing_started_at, processed_at, failure_reason FROM image WHERE id = (SELECT min(id) FROM image WHERE status = 'failed')")
def status_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "image")
    return api.status_of(images, _first(images, S.FAILED))


@query("""SELECT id, status, processed_at, analysis_result.overall_status AS overall_status, len(analysis_result.checks)::INTEGER AS checks FROM image WHERE id = (SELECT min(id) FROM image WHERE status = 'completed')""")
def results_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "image")
    told = api.results_of(images, _first(images, S.COMPLETED))
    return told.select("id", "status", "processed_at", "analysis.overall_status", F.when(F.col("analysis.checks").isNotNull(), F.size("analysis.checks")).alias("checks"))


@query("SELECT id, status, attempts, failure_reason FROM image WHERE id = (SELECT min(id) FROM image WHERE status = 'failed')")
def failure_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "image")
    return api.failure_of(images, _first(images, S.FAILED))


@query("SELECT id, status, uploaded_at, 'queued for analysis' AS message FROM image WHERE status = 'pending'")
def upload_acknowledged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.acknowledged(table(spark, sf_dir, "image").where(F.col("status") == S.PENDING))


@query("SELECT DISTINCT id AS image_id, 0::BIGINT AS seq, 'queued' AS event, uploaded_at AS event_at FROM image WHERE status = 'pending'")
def queued_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.queued(table(spark, sf_dir, "image").where(F.col("status") == S.PENDING)).drop("error")


_KNOWN = "concat('KA', lpad((abs(size_bytes) % 90 + 10)::VARCHAR, 2, '0'), 'MH', lpad((abs(size_bytes) % 10000)::VARCHAR, 4, '0'))"


@query(f"""WITH k AS (SELECT lower(sha256_hash) AS sha, min({_KNOWN}) AS plate FROM image WHERE mime_type = 'image/png' AND size_bytes > -2147483648 GROUP BY 1)
  SELECT id, plate IS NOT NULL AS passed, plate, substring(plate, 1, 2) AS state, substring(plate, 3, 2) AS rto, substring(plate, 5, 2) AS series, substring(plate, 7) AS number FROM image LEFT JOIN k ON lower(sha256_hash) = sha""")
def known_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plates of known files, by hash; the table of known plates stands in as one made from the uploads themselves."""
    images = table(spark, sf_dir, "image").select("id", "sha256_hash", "mime_type", "size_bytes")
    part = lambda of, width: F.lpad(of.cast("string"), width, "0")
    size = F.abs("size_bytes")
    plate = F.concat(F.lit("KA"), part(size % 90 + 10, 2), F.lit("MH"), part(size % 10000, 4))
    known = images.where("mime_type = 'image/png' and size_bytes > -2147483648").select("sha256_hash", plate.alias("plate"))
    made = plates.SuppliedText().text(plates.with_known(images, known)).withColumn("c", plates.check(CONFIG))
    got = lambda n: F.get_json_object("c.details_json", f"$.{n}")
    return made.select("id", "c.passed", got("extractedPlate").alias("plate"), got("stateCode").alias("state"), got("rtoCode").alias("rto"), got("seriesCode").alias("series"), got("uniqueNumber").alias("number"))


_EVENTS = "ev AS (SELECT DISTINCT * FROM job_event)"
_CURRENT = f"""{_EVENTS}, a AS (SELECT image_id, max(seq) AS last_seq, count(*) FILTER (event = 'processing')::INTEGER AS attempts, count(*) FILTER (event = 'failed_attempt')::INTEGER AS failures,
    max_by(event_at, seq) FILTER (event = 'processing') AS processing_started_at, count(*) FILTER (event = 'completed') > 0 AS done, count(*) FILTER (event = 'failed') > 0 AS ended,
    max_by(event_at, seq) FILTER (event = 'completed') AS done_at, max_by(event_at, seq) FILTER (event IN ('failed', 'failed_attempt')) AS failed_at,
    arg_max_null(error, seq) FILTER (event IN ('failed', 'failed_attempt')) AS error FROM ev GROUP BY image_id),
  cur AS (SELECT image_id, CASE WHEN done THEN 'completed' WHEN failures >= 3 OR ended THEN 'failed' WHEN attempts > 0 THEN 'processing' ELSE 'pending' END AS status, attempts, failures,
    CASE WHEN NOT done AND (failures >= 3 OR ended) THEN substring(error, 1, 500) END AS failure_reason, processing_started_at, CASE WHEN done THEN done_at WHEN failures >= 3 OR ended THEN failed_at END AS processed_at, last_seq FROM a)"""


@query(f"WITH {_CURRENT} SELECT * FROM cur")
def lifecycle_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.current(table(spark, sf_dir, "job_event"), CONFIG)


@query(f"""WITH {_EVENTS}, f AS (SELECT image_id, seq, event_at, row_number() OVER (PARTITION BY image_id ORDER BY seq)::INTEGER AS failure_no FROM ev WHERE event = 'failed_attempt')
  SELECT image_id, seq, failure_no, failure_no >= 3 AS terminal, CASE WHEN failure_no < 3 THEN epoch_ms(event_at) + (2000 * pow(2, failure_no - 1))::BIGINT END AS retry_at_ms FROM f""")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.retry_schedule(table(spark, sf_dir, "job_event"), CONFIG)


@query(f"""WITH {_CURRENT}, d AS (SELECT image_id, status, processed_at FROM cur WHERE status = 'completed' AND epoch(TIMESTAMP '2019-03-20 12:00:00') - floor(epoch(processed_at)) <= 3600 ORDER BY processed_at DESC, image_id LIMIT 1000)
  SELECT * FROM d UNION ALL SELECT image_id, status, processed_at FROM cur WHERE status = 'failed' AND epoch(TIMESTAMP '2019-03-20 12:00:00') - floor(epoch(processed_at)) <= 86400""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = lifecycle.current(table(spark, sf_dir, "job_event"), CONFIG).select("image_id", "status", "processed_at")
    return lifecycle.retained(jobs, F.lit("2019-03-20 12:00:00").cast("timestamp"), CONFIG)


@query("SELECT e.image_id, i.id IS NULL AS missing, count(*) AS events FROM job_event e LEFT JOIN image i ON e.image_id = i.id GROUP BY ALL")
def job_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "job_event").groupBy("image_id").agg(F.count(F.lit(1)).alias("events"))
    return lifecycle.with_missing(jobs, table(spark, sf_dir, "image"))


# -- uploads and display ----------------------------------------------------------------------------

@query("""SELECT id, stored_filename, CASE WHEN mime_type IS NULL OR mime_type NOT IN ('image/jpeg', 'image/png', 'image/webp') THEN 'unsupported type' WHEN size_bytes IS NULL OR size_bytes > 15728640 THEN 'too large' END AS reason FROM manifest""")
def upload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, refused = ingest.split_manifest(table(spark, sf_dir, "manifest"), CONFIG)
    return accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(refused).select("id", "stored_filename", "reason")


@query("""SELECT id, CASE mime_type WHEN 'image/jpeg' THEN concat(id, '.jpg') WHEN 'image/png' THEN concat(id, '.png') WHEN 'image/webp' THEN concat(id, '.webp') END AS name
  FROM (SELECT DISTINCT id, mime_type FROM manifest WHERE mime_type IN ('image/jpeg', 'image/png', 'image/webp') AND size_bytes <= 15728640)""")
def stored_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, _ = ingest.split_manifest(table(spark, sf_dir, "manifest"), CONFIG)
    return accepted.select("id", "mime_type").distinct().select("id", ingest.stored_name(F.col("id"), F.col("mime_type")).alias("name"))


@query(f"""WITH {_REPORTS} SELECT id, list_transform(list_filter(k, lambda c: NOT c.passed)[1:3], lambda c: concat(regexp_replace(c."check", '_', ' '), ':', coalesce(c.severity, 'low'))) AS tags FROM f""")
def failed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "image").where(F.col("analysis_result.checks").isNotNull())
    return rows.select("id", dashboard.failed_tags(F.col("analysis_result.checks")).alias("tags"))


@query("""WITH l AS (SELECT id, size_bytes, CASE WHEN size_bytes >= 1073741824 THEN 3 WHEN size_bytes >= 1048576 THEN 2 WHEN size_bytes >= 1024 THEN 1 WHEN size_bytes >= 1 THEN 0 END AS p FROM image),
  v AS (SELECT id, p, floor(size_bytes / pow(1024, p) * 10 + 0.5) / 10 AS x FROM l)
  SELECT id, CASE WHEN p IS NULL THEN '0 B' ELSE concat(CASE WHEN x = floor(x) THEN x::BIGINT::VARCHAR ELSE x::VARCHAR END, ' ', ['B', 'KB', 'MB', 'GB'][p + 1]) END AS size FROM v""")
def size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "image").select("id", C.size_label(F.col("size_bytes")).alias("size"))


@query(f"""WITH s AS (SELECT id, (epoch(TIMESTAMP '{NOW}') - floor(epoch(uploaded_at)))::BIGINT AS s FROM image)
  SELECT id, CASE WHEN s < 60 THEN 'JUST NOW' WHEN s < 3600 THEN concat(s // 60, 'M AGO') WHEN s < 86400 THEN concat(s // 3600, 'H AGO') ELSE concat(s // 86400, 'D AGO') END AS age FROM s""")
def age_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "image").select("id", C.age_label(F.col("uploaded_at"), F.lit(NOW).cast("timestamp")).alias("age"))


@query("""WITH c AS (SELECT id, list_filter(analysis_result.checks, lambda c: c IS NOT NULL AND c."check" = 'ocr_plate_validation' AND c.passed)[1] AS c FROM image)
  SELECT id, CASE WHEN json_valid(c.details_json) AND json_type(c.details_json::JSON) = 'OBJECT' THEN nullif(c.details_json::JSON->>'$.extractedPlate', '') END AS plate FROM c""")
def plate_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "image").select("id", dashboard.plate_of(F.col("analysis_result.checks")).alias("plate"))


@query("SELECT id, CASE WHEN coalesce(split_part(mime_type, '/', 2), '') = '' THEN 'IMG' ELSE upper(split_part(mime_type, '/', 2)) END AS badge FROM image")
def mime_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "image").select("id", C.mime_badge(F.col("mime_type")).alias("badge"))


@query("""SELECT DISTINCT check_name, CASE check_name WHEN 'blur_detection' THEN 'SHARPNESS' WHEN 'brightness_analysis' THEN 'EXPOSURE' WHEN 'dimension_validation' THEN 'RESOLUTION' WHEN 'duplicate_detection' THEN 'DUPLICATE'
  WHEN 'screenshot_rephoto_heuristic' THEN 'SCREENSHOT' WHEN 'metadata_analysis' THEN 'METADATA' WHEN 'tampering_heuristic' THEN 'TAMPERING' WHEN 'ocr_plate_validation' THEN 'PLATE' ELSE upper(replace(check_name, '_', ' ')) END AS label FROM check_result""")
def check_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "check_result").select("check_name", dashboard.check_label(F.col("check_name")).alias("label")).distinct()


@query("SELECT id, sha256(original_name) AS name_hash FROM image")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "image").select("id", ingest.content_hash(F.col("original_name")).alias("name_hash"))


@query("""SELECT a.id AS id_a, b.id AS id_b, CASE WHEN length(a.perceptual_hash) <> length(b.perceptual_hash) THEN 9007199254740991 ELSE
    bit_count(xor(('0x' || a.perceptual_hash)::UBIGINT, ('0x' || b.perceptual_hash)::UBIGINT))::BIGINT END AS distance
  FROM (SELECT id, perceptual_hash, row_number() OVER (ORDER BY id) AS k FROM image WHERE regexp_full_match(perceptual_hash, '[0-9a-f]{16}')) a
  JOIN (SELECT id, perceptual_hash, row_number() OVER (ORDER BY id) AS k FROM image WHERE regexp_full_match(perceptual_hash, '[0-9a-f]{16}')) b ON b.k = a.k + 1""")
def hamming_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of fingerprints next to each other in id order, by the text form."""
    held = table(spark, sf_dir, "image").where(F.col("perceptual_hash").rlike("^[0-9a-f]{16}$")).select(F.col("id"), F.col("id").alias("uploaded_at"), "perceptual_hash")
    placed = duplicates.with_sequence(held)
    after = placed.select(F.col("id").alias("id_b"), F.col("perceptual_hash").alias("other"), (F.col("seq") - 1).alias("seq"))
    return placed.join(after, "seq").select(F.col("id").alias("id_a"), "id_b", C.hamming_hex(F.col("perceptual_hash"), F.col("other")).alias("distance"))
