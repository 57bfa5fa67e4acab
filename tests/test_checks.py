import pytest
from pyspark.sql import functions as F

from frameloom import schema as S
from frameloom.config import Config
from frameloom.operators import checks, report

EXIF = "struct<make:string,model:string,captured_at:string,gps_latitude:double,software:string,tag_count:int>"
DDL = f"width int, height int, format string, exif {EXIF}, laplacian_var double, resized_to string, mean_red double, mean_luma double, ela_sum bigint, ela_n bigint, ela_max int, pixel_error string, header_error string"
BASE = {"width": 1000, "height": 1000, "format": "jpeg", "exif": None, "laplacian_var": 500.0, "resized_to": "1x1", "mean_red": 100.0, "mean_luma": 100.0, "ela_sum": 100, "ela_n": 100, "ela_max": 5, "pixel_error": None, "header_error": None}


def run(spark, spec, config=Config(), **changes):
    row = BASE | changes
    made = spark.createDataFrame([tuple(row.values())], DDL).select(checks.column_of(spec, config).alias("c")).first().c
    return made


SPEC = {s.name: s for s in checks.REGISTRY}


NO_TAGS = {"make": None, "model": None, "captured_at": None, "gps_latitude": None, "software": None, "tag_count": 0}


def exif(**tags):
    return tuple((NO_TAGS | tags).values())


def test_order_is_fixed():
    assert tuple(s.name for s in checks.REGISTRY) == S.CHECK_ORDER


@pytest.mark.parametrize(
    "name,changes,passed",
    [
        (S.BLUR, {"laplacian_var": 100.0}, True), (S.BLUR, {"laplacian_var": 99.99}, False), (S.BRIGHTNESS, {"mean_red": 60.0}, True), (S.BRIGHTNESS, {"mean_red": 200.0}, True),
        (S.BRIGHTNESS, {"mean_red": 59.99}, False), (S.BRIGHTNESS, {"mean_red": 200.01}, False), (S.DIMENSIONS, {"width": 400, "height": 300}, True), (S.DIMENSIONS, {"width": 399, "height": 300}, False),
        (S.DIMENSIONS, {"width": 400, "height": 299}, False), (S.DIMENSIONS, {"width": 300, "height": 400}, False), (S.DIMENSIONS, {"width": None, "height": None}, False),
    ],
)
def test_thresholds_are_strict(spark, name, changes, passed):
    assert run(spark, SPEC[name], **changes).passed is passed


@pytest.mark.parametrize("most,passed", [(40, True), (41, False)])
def test_spike_ratio(spark, most, passed):
    documented = Config(profile="documented")
    assert run(spark, SPEC[S.TAMPERING], documented, ela_max=most).passed is passed
    assert run(spark, SPEC[S.TAMPERING], documented, ela_sum=0, ela_max=0).passed and run(spark, SPEC[S.TAMPERING], ela_max=most).passed
    assert '"skipped":true' in run(spark, SPEC[S.TAMPERING], documented, format="png").details_json


# Size, format, tags; verdicts of the screenshot and camera data checks; signals.
CASES = [
    ((1080, 1920, "png", exif()), (False, "high"), True, 3), ((1920, 1080, "jpeg", exif()), (False, "high"), False, 2), ((1080, 1920, "jpeg", exif(make="M", tag_count=1)), (True, "none"), True, 1),
    ((1000, 1000, "png", exif()), (True, "none"), True, 2), ((1000, 1000, "jpeg", exif()), (True, "none"), False, 1), ((1000, 1000, "jpeg", exif(make="M", software="Adobe PHOTOSHOP 25", tag_count=2)), (False, "medium"), True, 0),
    ((1080, 1920, "jpeg", exif(software="Screenshot", tag_count=1)), (False, "high"), True, 2), ((1000, 1000, "jpeg", None), (True, "none"), False, 1),
]


@pytest.mark.parametrize("given,shot,meta,signals", CASES)
def test_screenshot_and_camera_data(spark, given, shot, meta, signals):
    width, height, kind, tags = given
    c = run(spark, SPEC[S.SCREENSHOT], width=width, height=height, format=kind, exif=tags)
    assert (c.passed, c.severity) == shot and f'"screenshotSignalCount":{signals}' in c.details_json
    assert run(spark, SPEC[S.METADATA], width=width, height=height, format=kind, exif=tags).passed is meta


def test_an_error_fails_its_check_alone(spark):
    c = run(spark, SPEC[S.BLUR], pixel_error="no pixels", laplacian_var=None)
    assert (c.passed, c.severity) == (False, "low") and "no pixels" in c.details_json
    assert run(spark, SPEC[S.DIMENSIONS], pixel_error="no pixels").passed


def test_details_keep_explicit_nulls(spark):
    assert '"cameraMake":null' in run(spark, SPEC[S.METADATA]).details_json


def test_own_checks_count_in_the_score(spark):
    own = checks.CheckSpec("always", lambda c: checks.verdict("always", F.lit(False), F.lit("high"), F.lit("{}"), F.lit("m")))
    rows = spark.createDataFrame([tuple(BASE.values())], DDL)
    got = report.analyze(rows, Config(), (SPEC[S.BLUR], own)).first().analysis_result
    assert (got.overall_status, got.issues_found, got.confidence_score) == ("flagged", ["always"], 0.5)
    assert report.analyze(rows, Config(), (SPEC[S.BLUR],)).first().analysis_result.confidence_score == 1.0
