import itertools

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frameloom.config import Config
from frameloom.functions import columns as C
from frameloom.functions.hashes import hex64, usable_hex
from frameloom.operators import plates, report
from frameloom.sources import ingest


def test_environment_rules():
    c = Config.from_env({"FRAMELOOM_BLUR_THRESHOLD": "", "FRAMELOOM_LOW_LIGHT": "0", "FRAMELOOM_OVEREXPOSED": "inf", "FRAMELOOM_MIN_WIDTH": "-5", "FRAMELOOM_MIN_HEIGHT": "abc", "FRAMELOOM_PROFILE": "documented"})
    assert (c.blur_threshold, c.low_light, c.overexposed, c.min_width, c.min_height, c.profile) == (100.0, 0.0, 200.0, -5, 300, "documented")


def test_usable_hashes(spark):
    h = "ab" * 32
    texts = [h, h.upper(), f" {h}\n", f"sha256:{h}", f"SHA256:{h}", f"sha-256 {h}", f"0x{h}", h[:-1], h + "a", "", None, h[:60] + "????", f" {h}​"]
    got = [r.u for r in spark.createDataFrame([(t,) for t in texts], "t string").select(usable_hex(F.col("t"), 64).alias("u")).collect()]
    assert got == [h] * 7 + [None] * 5 + [h]


@given(st.integers(0, 2**64 - 1))
def test_hex64_matches_python(value):
    signed = value - (1 << 64) if value >> 63 else value
    text = f"{value:016x}"
    assert (int(text[:8], 16) << 32 | int(text[8:], 16)) == value and -(1 << 63) <= signed < 1 << 63


def test_hex64_column(spark):
    texts = ["ffffffffffffffff", "8000000000000000", "0000000000000001", "14944d4a1966b5d3"]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(hex64(F.col("t")).alias("v")).collect()]
    assert [v & (1 << 64) - 1 for v in got] == [int(t, 16) for t in texts]


def test_flat_images_collide_and_halves_do_not(spark):
    left = [255] * 4 + [0] * 4
    rows = [("black", [0] * 64), ("white", [255] * 64), ("left", left * 8), ("right", left[::-1] * 8), ("none", None)]
    got = {r.id: r.perceptual_hash for r in ingest.with_fingerprint(spark.createDataFrame(rows, "id string, thumb8x8 array<int>")).collect()}
    assert got == {"black": "f" * 16, "white": "f" * 16, "left": "f0" * 8, "right": "0f" * 8, "none": None}
    pairs = spark.createDataFrame([("f0" * 8, "0f" * 8), ("f0" * 8, "f0" * 8), ("f0" * 8, "f0" * 7)], "a string, b string")
    assert [r.d for r in pairs.select(C.hamming_hex(F.col("a"), F.col("b")).alias("d")).collect()] == [64, 0, C.FAR]


# Scores by penalty for eight checks.
SCORES = [1.0, 0.96, 0.92, 0.88, 0.83, 0.79, 0.75, 0.71, 0.67, 0.63, 0.58, 0.54, 0.5, 0.46, 0.42, 0.38, 0.33, 0.29, 0.25, 0.21]


def test_scores(spark):
    rows = spark.createDataFrame([(p, 8) for p in range(20)] + [(0, 0), (99, 8)], "p int, n int")
    assert [r.s for r in rows.select(report.confidence(F.col("p"), F.col("n")).alias("s")).collect()] == [*SCORES, 1.0, 0.0]


# Plate texts and what must be read from them.
PLATES = [
    ("KA05MH1234", "KA05MH1234", "05", "KA05MH1234"), ("ka 05-mh\n1234 ok", "KA05MH1234", "05", "KA 05-MH 1234"), ("MH1A2345", "MH01A2345", "1", "MH1A2345"),
    ("KA  05  MH  1234", "KA05MH1234", "05", "KA 05 MH 1234"), ("DL.3.C.4567", "DL03C4567", "3", "DL 3 C 4567"), ("A KA05MH1234 MH12KR1145", "KA05MH1234", "05", "KA05MH1234"),
    ("KA 05 MH 1234", "KA05MH1234", "05", "KA 05 MH 1234"),
] + [(t, None, None, None) for t in ("KA - 05 MH 1234", "KA--05MH1234", "XKA05MH1234", "KA05MH12345", "KA051234", "KA05ABC1234", "")]


def test_plates(spark):
    got = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(PLATES)], "i int, t string").select("i", plates.parts(plates.normalized(F.col("t"))).alias("p")).orderBy("i").collect()
    assert [(r.p.plate, r.p.rto, r.p.raw) for r in got] == [p[1:] for p in PLATES]


def test_plate_check_branches_and_known_plates(spark):
    images = spark.createDataFrame([("a", "S1", "KA05MH1234"), ("b", "s2", None), ("c", "s3", "nothing"), ("d", "s4", None)], "id string, sha256_hash string, ocr_text string")
    known = spark.createDataFrame([("S4", "MH12AB0001"), ("s4", "MH12AB0001")], "sha256_hash string, plate string")
    rows = plates.with_known(plates.SuppliedText().text(images), known).withColumn("c", plates.check(Config()))
    got = {r.id: (r.c.passed, r.c.severity) for r in rows.collect()}
    assert got == {"a": (True, "none"), "b": (False, "low"), "c": (False, "medium"), "d": (True, "none")}


@pytest.mark.parametrize("size,label", [(0, "0 B"), (1, "1 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "1.5 KB"), (15728640, "15 MB"), (2147483647, "2 GB"), (-1, "0 B")])
def test_size_labels(spark, size, label):
    assert spark.range(1).select(C.size_label(F.lit(size)).alias("s")).first().s == label


@given(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1))
def test_distance_is_a_metric(a, b, c):
    d = lambda x, y: (x ^ y).bit_count()
    assert d(a, a) == 0 and d(a, b) == d(b, a) and d(a, c) <= d(a, b) + d(b, c)


def test_pigeonhole_choices_cover_every_error_pattern():
    pieces, distance = 7, 5
    for spoiled in itertools.combinations(range(pieces), distance):
        assert any(not set(kept) & set(spoiled) for kept in itertools.combinations(range(pieces), pieces - distance))
