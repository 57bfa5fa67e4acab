import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import exif_block, jpeg, png, solid, webp, with_exif
from frameloom import schema as S
from frameloom.config import Config
from frameloom.operators import duplicates, plates, report
from frameloom.sources import exif, header, ingest, pixels
from frameloom.streaming import pipeline


def noise(seed, w, h):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3), dtype=np.uint8)


def test_headers():
    assert header.read_header(png(solid(7, 5, 1, 2, 3))) == (7, 5, "png")
    assert header.read_header(webp(640, 480)) == (640, 480, "webp")
    for bad in (b"", None, b"GIF89a", b"\xff\xd8\xff", b"\xff\xd8\xff\xe0\x00\x04ab", b"\x89PNG\r\n\x1a\n", b"RIFF1234WEBPVP8 "):
        with pytest.raises(header.Unreadable):
            header.read_header(bad)


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif_tags_and_damage(spark, tmp_path, order):
    plain = jpeg(spark, solid(16, 16, 9, 9, 9), str(tmp_path / "a.jpg"))
    assert exif.read_exif(plain) == exif.EMPTY
    block = exif_block(order, make="Orvex", software="Adobe PHOTOSHOP 25", captured_at="2019:03:01 10:00:00", latitude=-12)
    got = exif.read_exif(with_exif(plain, block))
    assert (got["make"], got["model"], got["software"], got["captured_at"], got["gps_latitude"]) == ("Orvex", None, "Adobe PHOTOSHOP 25", "2019:03:01 10:00:00", -12.0) and got["tag_count"] == 5
    for cut in range(0, len(block), 7):
        assert exif.read_exif(with_exif(plain, block[:cut]))["tag_count"] >= 0
    assert header.read_header(with_exif(plain, block)) == (16, 16, "jpeg")


def test_pixel_measures():
    flat = pixels.measures(solid(60, 40, 128, 128, 128), 800, 90, True)
    assert flat["laplacian_var"] == 0 and flat["mean_red"] == flat["mean_luma"] == 128 and flat["thumb8x8"] == [128] * 64 and flat["ela_max"] <= 1
    assert pixels.measures(noise(1, 600, 400), 800, 90, False)["laplacian_var"] > 100
    red = pixels.measures(solid(20, 20, 255, 0, 0), 800, 90, False)
    assert red["mean_red"] == 255 and red["mean_luma"] < 130
    assert pixels.fit(1200, 900, 800) == (800, 600) and pixels.fit(100, 80, 800) == (100, 80)
    wide = pixels.resize(np.tile(np.repeat([255, 0], 250).astype(np.uint8), (400, 1)), 8, 8)
    assert (wide[:, :3] > 240).all() and (wide[:, 5:] < 15).all()


def test_recompression_error_is_larger_where_pasted():
    image = np.full((64, 64, 3), 120, np.uint8)
    image[20:28, 20:28] = noise(2, 8, 8)
    m = pixels.measures(image, 800, 90, True)
    assert m["ela_max"] / (m["ela_sum"] / m["ela_n"]) > 5
    assert np.abs(pixels.recompressed(noise(3, 33, 17), 90).astype(int) - noise(3, 33, 17)).mean() < 60


def test_files_to_reports(spark, tmp_path):
    d = tmp_path / "files"
    d.mkdir()
    files = {
        "flat.jpg": jpeg(spark, solid(600, 400, 128, 128, 128), str(tmp_path / "f.jpg")), "dark.jpg": jpeg(spark, solid(400, 300, 5, 5, 5), str(tmp_path / "d.jpg")),
        "bright.jpg": jpeg(spark, solid(400, 300, 250, 250, 250), str(tmp_path / "b.jpg")), "tiny.jpg": jpeg(spark, solid(100, 80, 51, 51, 51), str(tmp_path / "t.jpg")),
        "noisy.png": png(noise(5, 600, 400)), "copy.png": png(noise(5, 600, 400)), "shot.png": png(solid(1080, 1920, 90, 90, 90)), "broken.jpg": b"\xff\xd8\xff\xe0 nothing", "odd.webp": webp(640, 480),
    }
    camera = exif_block(make="Orvex", model="R4")
    files["camera.jpg"] = with_exif(files["flat.jpg"], camera)
    for name, body in files.items():
        (d / name).write_bytes(body)
    kind = {"jpg": "image/jpeg", "png": "image/png", "ebp": "image/webp"}
    t0 = dt.datetime(2019, 3, 1)
    rows = [(n, n, n, f"uploads/{n}", kind[n[-3:]], len(b), t0 + dt.timedelta(minutes=i)) for i, (n, b) in enumerate(files.items())]
    rows += [("big", "big", "big.jpg", "x", "image/jpeg", 15 * 1024 * 1024 + 1, t0), ("gif", "gif", "g.gif", "x", "image/gif", 5, t0), ("gone", "gone", "gone.jpg", "x", "image/jpeg", 15 * 1024 * 1024, t0), rows[0]]
    pending, refused = ingest.ingest(spark, spark.createDataFrame(rows, S.MANIFEST), str(d), Config())
    assert {(r.id, r.reason) for r in refused.collect()} == {("big", "too large"), ("gif", "unsupported type"), ("gone", "file is missing")}
    pending = pending.cache()
    assert pending.count() == len(files) and "content" not in pending.columns
    matched = pending.join(duplicates.verdicts(pending.where("sha256_hash is not null"), Config()), "id", "left")
    ready = plates.with_known(plates.SuppliedText().text(matched), None)
    got = {r.id: {c["check"]: c for c in r.analysis_result.checks} for r in report.analyze(ready, Config()).collect()}
    verdict = {i: {n: (c.passed, c.severity) for n, c in cs.items()} for i, cs in got.items()}
    assert verdict["flat.jpg"][S.BLUR] == (False, "high") and verdict["noisy.png"][S.BLUR] == (True, "none")
    assert verdict["dark.jpg"][S.BRIGHTNESS] == verdict["bright.jpg"][S.BRIGHTNESS] == (False, "medium") and verdict["flat.jpg"][S.BRIGHTNESS] == (True, "none")
    assert verdict["tiny.jpg"][S.DIMENSIONS] == (False, "high") and verdict["flat.jpg"][S.DIMENSIONS] == (True, "none")
    assert verdict["copy.png"][S.DUPLICATE] == verdict["noisy.png"][S.DUPLICATE] == (False, "high")
    assert verdict["flat.jpg"][S.DUPLICATE] == (False, "medium"), "flat images have one fingerprint"
    assert verdict["shot.png"][S.SCREENSHOT] == (False, "high") and verdict["flat.jpg"][S.SCREENSHOT] == (True, "none")
    assert verdict["flat.jpg"][S.METADATA] == (False, "low") and verdict["camera.jpg"][S.METADATA] == (True, "none") and verdict["shot.png"][S.METADATA] == (True, "none")
    assert verdict["flat.jpg"][S.TAMPERING] == (True, "none") and '"skipped":true' in got["noisy.png"][S.TAMPERING].details_json
    assert verdict["broken.jpg"][S.BLUR] == verdict["broken.jpg"][S.DIMENSIONS] == (False, "low")
    assert verdict["odd.webp"][S.DIMENSIONS] == (True, "none") and verdict["odd.webp"][S.BLUR] == (False, "low")
    assert all(v[S.PLATE] == (False, "low") for v in verdict.values())
    documented = ingest.extract(spark, str(d), Config(profile="documented")).where("stored_filename = 'flat.jpg'").first()
    assert documented.ela_n == 600 * 400 * 3 and documented.ela_max <= 2
    assert dict(pending.select(F.col("id"), "perceptual_hash").collect())["flat.jpg"] == "f" * 16


def test_files_as_they_arrive(spark, tmp_path):
    d = tmp_path / "drop"
    d.mkdir()
    rows = []
    for i in range(3):
        body = png(noise(i, 40, 30))
        (d / f"{i}.png").write_bytes(body)
        rows.append((f"id{i}", "n", f"{i}.png", "p", "image/png" if i else "image/gif", len(body), dt.datetime(2019, 3, 1)))
    manifest = spark.createDataFrame(rows, S.MANIFEST)
    start = lambda: pipeline.ingest_stream(spark, str(d), manifest, str(tmp_path / "sink"), str(tmp_path / "check"), Config(), 2).awaitTermination()
    start()
    (d / "late.png").write_bytes(png(noise(9, 40, 30)))
    start()
    pending = spark.read.parquet(str(tmp_path / "sink/pending")).collect()
    assert sorted(r.id for r in pending) == ["id1", "id2"] and all(r.status == "pending" and r.perceptual_hash for r in pending)
    assert [r.reason for r in spark.read.parquet(str(tmp_path / "sink/refused")).collect()] == ["unsupported type"]
    assert sorted((r.image_id, r.seq, r.event) for r in spark.read.parquet(str(tmp_path / "sink/events")).collect()) == [("id1", 0, "queued"), ("id2", 0, "queued")]


def test_only_accepted_files_are_read_and_names_may_repeat_in_folders(spark, tmp_path):
    for folder, seed in (("a", 1), ("b", 2)):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "x [1] +50%.png").write_bytes(png(noise(seed, 40, 30)))
    (tmp_path / "in" / "refused.png").write_bytes(b"not to be read")
    row = lambda i, name, kind: (i, name, name, "p", kind, 9, dt.datetime(2019, 3, 1))
    manifest = spark.createDataFrame([row("1", "x [1] +50%.png", "image/png"), row("2", "refused.png", "text/plain"), row("3", "none.png", "image/png")], S.MANIFEST)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    pending, refused = ingest.ingest(spark, manifest, str(tmp_path / "in"), Config())
    assert [(r.id, r.width, r.perceptual_hash is not None) for r in pending.collect()] == [("1", 40, True)]
    assert {(r.id, r.reason) for r in refused.collect()} == {("2", "unsupported type"), ("3", "file is missing")}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert not any("refused.png" in f for f in pending.inputFiles())
    nothing, refused = ingest.ingest(spark, manifest.where("id <> '1'"), str(tmp_path / "in"), Config())
    assert nothing.count() == 0 and refused.count() == 2 and nothing.columns == pending.columns


def test_identifiers_are_random_and_made_once(spark, tmp_path):
    uploads = spark.createDataFrame([("n", "image/png", 5, dt.datetime(2019, 3, 1))] * 4 + [("n", "text/plain", 5, None)], "original_name string, mime_type string, size_bytes int, uploaded_at timestamp")
    made = ingest.registered(spark, uploads, str(tmp_path / "manifest"), "uploads")
    first, second = sorted(map(tuple, made.collect()), key=str), sorted(map(tuple, made.collect()), key=str)
    assert first == second and len({r[0] for r in first}) == 5 and len({r[2] for r in first if r[2]}) == 4
    assert all(r[2] is None or (r[2].endswith(".png") and r[3] == f"uploads/{r[2]}" and r[2][:36] != r[0]) for r in first)


def test_fixed_decimals_in_messages(spark):
    from frameloom.functions.columns import fixed

    got = spark.createDataFrame([(0.25,), (12.0,), (99.949,), (-0.04,), (None,)], "x double").select(fixed(F.col("x"), 1).alias("t")).collect()
    assert [r.t for r in got][:3] == ["0.3", "12.0", "99.9"]
