import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from frameloom import api, dashboard
from frameloom import schema as S
from frameloom.config import Config
from frameloom.operators import lifecycle as L
from frameloom.streaming import pipeline as P

T0 = dt.datetime(2019, 3, 1, 12)
LOG = (
    [("ok", 1, "queued"), ("ok", 2, "processing"), ("ok", 3, "completed")]
    + [("spent", 1, "queued")] + [x for k in range(3) for x in (("spent", 2 + 2 * k, "processing"), ("spent", 3 + 2 * k, "failed_attempt"))] + [("spent", 8, "failed")]
    + [("gone", 1, "queued"), ("gone", 2, "failed_attempt"), ("gone", 3, "failed_attempt"), ("gone", 4, "failed_attempt")]
    + [("late", 1, "queued"), ("late", 2, "processing"), ("late", 3, "failed_attempt"), ("late", 4, "processing"), ("late", 5, "failed_attempt"), ("late", 6, "processing"), ("late", 7, "completed")]
    + [("waits", 1, "queued")] + [("runs", 1, "queued"), ("runs", 2, "processing"), ("runs", 3, "stalled")]
)


def events():
    rows = [(i, s, e, T0 + dt.timedelta(seconds=s), "x" * 600 if "failed" in e else None) for i, s, e in LOG]
    return rows


WANT = {"ok": ("completed", 1, 0), "spent": ("failed", 3, 3), "gone": ("failed", 0, 3), "late": ("completed", 3, 2), "waits": ("pending", 0, 0), "runs": ("processing", 1, 0)}


def test_current_state_from_a_shuffled_log_with_repeats(spark):
    rows = events() + events()[:9]
    random.Random(1).shuffle(rows)
    got = L.current(spark.createDataFrame(rows, S.JOB_EVENT), Config()).collect()
    assert {r.image_id: (r.status, r.attempts, r.failures) for r in got} == WANT
    by = {r.image_id: r for r in got}
    assert len(by["spent"].failure_reason) == 500 and by["late"].failure_reason is None and by["gone"].processing_started_at is None
    assert by["spent"].processed_at == T0 + dt.timedelta(seconds=8) and by["late"].processed_at == T0 + dt.timedelta(seconds=7)


def test_retry_delays(spark):
    got = {(r.image_id, r.failure_no): (r.terminal, r.retry_at_ms) for r in L.retry_schedule(spark.createDataFrame(events(), S.JOB_EVENT), Config()).collect()}
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert got["late", 1] == (False, base + 3000 + 2000) and got["late", 2] == (False, base + 5000 + 4000) and got["spent", 3] == (True, None)


def test_retention(spark):
    at = lambda s: T0 - dt.timedelta(seconds=s)
    jobs = spark.createDataFrame([("a", "completed", at(10)), ("b", "completed", at(3601)), ("c", "failed", at(3601)), ("d", "failed", at(86401)), ("e", "pending", None), ("f", "completed", at(20))], "image_id string, status string, processed_at timestamp")
    now = F.lit(T0)
    assert {r.image_id for r in L.retained(jobs, now, Config()).collect()} == {"a", "c", "f"}
    assert {r.image_id for r in L.retained(jobs, now, Config(keep_done_rows=1)).collect()} == {"a", "c"}


@pytest.mark.parametrize("order", ["as logged", "shuffled"])
def test_stream_equals_the_batch_answer_in_any_order_of_arrival(spark, tmp_path, order):
    rows, flat, out = events() + events()[:5], tmp_path / "flat", str(tmp_path / "out")
    if order == "shuffled":
        random.Random(7).shuffle(rows)
    flat.mkdir()

    def sink(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    for k in range(4):
        spark.createDataFrame(rows[k * 9 : k * 9 + 9], S.JOB_EVENT).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        (flat / f"{k}.parquet").write_bytes(next((tmp_path / f"part{k}").glob("*.parquet")).read_bytes())
        P.run_batches(P.retries(P.event_stream(spark, str(flat)), Config()), sink, str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(out)
    last = got.groupBy("image_id").agg(F.max_by(F.struct("status", "attempts", "failures", "failure_reason"), "events").alias("s")).select("image_id", "s.*")
    want = L.current(spark.createDataFrame(rows, S.JOB_EVENT), Config()).select("image_id", "status", "attempts", "failures", "failure_reason")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect())) and got.count() == len(LOG)
    if order == "as logged":
        assert {r.delay_ms for r in got.where("image_id = 'late'").collect()} == {None, 2000, 4000}


def test_a_signal_stops_a_query_and_a_restart_goes_on(spark, tmp_path):
    import os
    import signal

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"a")
    seen = []
    stream = P.file_stream(spark, str(tmp_path / "in")).select("path")
    start = lambda: stream.writeStream.foreachBatch(lambda b, n: seen.append(b.count())).option("checkpointLocation", str(tmp_path / "check")).start()
    before = signal.getsignal(signal.SIGUSR1)
    query = start()
    P.stop_on_signal(query, number=signal.SIGUSR1)
    query.processAllAvailable()
    os.kill(os.getpid(), signal.SIGUSR1)
    signal.signal(signal.SIGUSR1, before)
    query.awaitTermination(60)
    assert not query.isActive
    (tmp_path / "in" / "b.bin").write_bytes(b"b")
    again = start()
    again.processAllAvailable()
    again.stop()
    assert seen == [1, 1]


def test_file_stream_and_distinct_jobs(spark, tmp_path):
    d = tmp_path / "drop"
    d.mkdir()
    for k in range(3):
        (d / f"{k}.bin").write_bytes(bytes([k]))
    P.run_batches(P.file_stream(spark, str(d), 2).select("path", "length").withColumnRenamed("path", "id"), P.append_once(str(tmp_path / "sink")), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 3
    log = tmp_path / "log"
    spark.createDataFrame([(i, 1, "queued", T0, None) for i in ("a", "b", "a", "a")], S.JOB_EVENT).write.parquet(str(log))
    P.run_batches(P.distinct_jobs(P.event_stream(spark, str(log))), lambda b, n: b.write.mode("append").parquet(str(tmp_path / "jobs")), str(tmp_path / "c2")).awaitTermination()
    assert sorted(r.image_id for r in spark.read.parquet(str(tmp_path / "jobs")).collect()) == ["a", "b"]


A, B = "00000000-0000-0000-0000-00000000000a", "00000000-0000-0000-0000-00000000000B".lower()


@pytest.fixture(scope="module")
def images(spark):
    check = ("ocr_plate_validation", True, "none", '{"extractedPlate":"KA05MH1234"}', "m")
    bad = [("blur_detection", False, "high", "{}", "m"), ("metadata_analysis", False, None, "{}", "m"), None, ("a_b_c", False, "low", "{}", "m"), ("x", False, "low", "{}", "m")]
    report = ("flagged", ["blur_detection"], [*bad, check], 0.495)
    row = lambda i, status, at, reason=None, r=None: (i, f"{i}.jpg", "s.jpg", "p", "image/jpeg", 2048, at, status, reason, 1, "h", None, None, None, None, at, r)
    rows = [row(A, "completed", T0, "old", report), row(B, "failed", T0, "why")] + [row(f"{i:08}-0000-0000-0000-000000000000", "pending", T0 + dt.timedelta(minutes=i)) for i in range(1, 131)]
    return spark.createDataFrame(rows, S.IMAGE)


def test_listing(images):
    page = api.list_images(images, None, "500", "1")
    assert (page.total, page.limit, page.offset) == (132, 100, 1) and len(page.items.columns) == 11
    ids = [r.id for r in page.items.collect()]
    assert ids[0].startswith("00000129") and len(ids) == 100
    assert api.list_images(images, "completed").total == 1
    assert [api.page_bounds(x, None, Config())[0] for x in (None, "0", "abc", "100", "101")] == [20, 20, 20, 100, 100]
    for bad in (("nonsense", None, None), (None, "-5", None), (None, None, "-1")):
        with pytest.raises(api.BadRequest):
            api.list_images(images, *bad)


def test_point_reads(images):
    assert api.status_of(images, A).first().failure_reason is None and api.status_of(images, B).first().failure_reason == "why"
    assert api.results_of(images, A).first().analysis.overall_status == "flagged" and api.failure_of(images, B).first().attempts == 1
    with pytest.raises(api.NotReady):
        api.results_of(images, B)
    with pytest.raises(api.NotReady):
        api.failure_of(images, A)
    with pytest.raises(api.NotFound):
        api.status_of(images, A.replace("a", "f"))
    with pytest.raises(api.BadRequest):
        api.status_of(images, "x' or '1'='1")


def test_client_forms(images):
    assert api.results_or_state(images, B) == {"notReady": True, "status": "failed"} and api.failure_or_none(images, A) is None
    assert api.results_or_state(images, A).count() == api.failure_or_none(images, B).count() == 1 and api.unfinished(images).count() == 130


def test_health_json_and_acknowledgement(spark, images):
    assert api.health(spark).first().status == "ok"
    assert '"status":"completed"' in api.as_json(api.results_of(images, A)).first().json
    assert api.acknowledged(images).columns == ["id", "status", "uploaded_at", "message"]


def test_cards(images):
    r = dashboard.cards(images.where(F.col("id") == A), F.lit(T0 + dt.timedelta(hours=25))).first()
    assert (r.badge, r.size, r.age, r.confidence, r.band, r.plate) == ("JPEG", "2 KB", "1D AGO", 50, "warn", "KA05MH1234")
    assert r.tags == ["blur detection:high", "metadata analysis:low", "a b_c:low"]
    assert dashboard.counts(images).first().asDict() == {"shown": 132, "completed": 1, "flagged": 1, "active": 130}


def test_filter_reaches_the_scan(spark, images, tmp_path):
    images.write.parquet(str(tmp_path / "t"))
    plan = api.listed(spark.read.parquet(str(tmp_path / "t")), "failed")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,failed)" in plan and "sha256_hash" not in plan
