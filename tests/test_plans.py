"""Plans and the entry points: what is pushed down, which joins are chosen, that SQL and queries match by name."""

import json
import logging

import __spark_entry__ as entry
from frameloom import log
from frameloom.plans import core

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(core.queries()) <= set(entry.queries())


def test_every_core_query_runs_on_the_smallest_tables(spark):
    for name, query in core.queries().items():
        assert query(spark, DIR).count() >= 0, name
    assert entry.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(core.queries()["list_images"](spark, DIR))
    assert "EqualTo(status,completed)" in text and "perceptual_hash" not in text
    assert "issues_found" not in plan(core.queries()["status_counts"](spark, DIR))
    scan = next(line for line in plan(core.queries()["inspection_report"](spark, DIR)).splitlines() if "ReadSchema" in line)
    assert "stored_filename" not in scan and "confidence_score" not in scan


def test_reports_need_no_shuffle(spark):
    assert "Exchange" not in plan(core.queries()["inspection_report"](spark, DIR))


def test_nested_loop_join_only_for_the_bounded_window(spark):
    loops = {n for n in ("exact_duplicates", "near_duplicates_window", "near_duplicates_banded", "near_duplicates_upload", "duplicate_verdicts") if "NestedLoop" in plan(core.queries()[n](spark, DIR)) or "Cartesian" in plan(core.queries()[n](spark, DIR))}
    assert loops <= {"near_duplicates_window", "duplicate_verdicts"}


def test_json_log_lines():
    record = logging.LogRecord("n", logging.WARNING, "f", 1, "said %s", ("so",), None)
    record.meta = {"imageId": "a"}
    line = json.loads(log.JsonFormatter().format(record))
    assert (line["level"], line["msg"], line["imageId"]) == ("warning", "said so", "a") and line["ts"].endswith("+00:00")
