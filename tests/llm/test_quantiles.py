import math
import random

from pyspark.sql import functions as F

from frameloom.llm import quantiles as Q

DDL = "g string, day string, x double, n int"


def data(seed=1, n=3000):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        g = "hot" if rng.random() < 0.6 else rng.choice("ab")
        x = rng.choice([rng.lognormvariate(8, 3), -rng.lognormvariate(1, 2), 0.0, 1.0, rng.uniform(0, 1)])
        out.append((g, f"d{i % 7}", x, 1))
    return out


def test_error_is_bounded_and_days_merge(spark):
    rows = data()
    table = spark.createDataFrame(rows + [("hot", "d1", None, 1), ("hot", "d1", float("nan"), 1), ("hot", "d2", float("inf"), 1), ("void", "d0", None, 1)], DDL)
    daily = Q.sketch(table, ["g", "day"], F.col("x"))
    whole = {tuple(r) for r in Q.sketch(table, ["g"], F.col("x")).collect()}
    assert {tuple(r) for r in Q.merge(daily, ["g"]).collect()} == whole
    got = Q.percentiles(Q.merge(daily, ["g"]), ["g"]).collect()
    assert {r.g for r in got} == {"hot", "a", "b"} and len(got) == 3 * len(Q.PERCENTILES)
    for r in got:
        values = sorted(x for g, _, x, _ in rows if g == r.g)
        true = values[max(1, math.ceil(round(r.percentile * len(values), 6))) - 1]
        assert r.n_values == len(values)
        assert abs(r.estimate - true) <= Q.RELATIVE_ERROR * abs(true) * (1 + 1e-9), (r, true)


def test_edges_of_buckets(spark):
    gamma = Q.gamma_of(Q.RELATIVE_ERROR)
    values = [1.0, gamma, gamma**2, 2147483646.0, 1e-12, -5.0]
    for v in values:
        r = Q.percentiles(Q.sketch(spark.createDataFrame([("g", "d", v, 1)], DDL), ["g"], F.col("x")), ["g"], (0.5,)).first()
        assert abs(r.estimate - v) <= Q.RELATIVE_ERROR * abs(v) * (1 + 1e-9)


def test_kinds_and_measures(spark):
    ddl = "mime_type string, size_bytes int, uploaded_at timestamp, analysis_result struct<confidence_score:double>, day string"
    import datetime as dt

    t = dt.datetime(2019, 3, 1)
    table = spark.createDataFrame(
        [(" Image/JPG; q=1", 5, t, (0.5,), "x"), ("image/jpeg", 0, t, (1.5,), "x"), (None, 2147483647, t, None, "x"), ("", -1, t, (float("nan"),), "x"), ("image/png", 7, t, (0.0,), "x")], ddl
    )
    got = sorted((r.kind, r.measure, r.x) for r in Q.measures(table).collect())
    assert got == [("image/jpeg", "confidence_score", 0.5), ("image/jpeg", "size_bytes", 5.0), ("image/png", "confidence_score", 0.0), ("image/png", "size_bytes", 7.0)]


def test_the_promise_is_checked_by_counting(spark):
    import datetime as dt

    rng = random.Random(4)
    rows = [(rng.choice(["image/png", "image/jpeg"]), int(rng.lognormvariate(10, 2)) + 1, dt.datetime(2019, 3, 1 + i % 3), (rng.choice([0.0, 1.0, rng.random()]),)) for i in range(2000)]
    table = spark.createDataFrame(rows, "mime_type string, size_bytes int, uploaded_at timestamp, analysis_result struct<confidence_score:double>")
    got = Q.kept_promise(table).collect()
    assert len(got) == 4 * len(Q.PERCENTILES) and all(r.within for r in got)


def test_empty(spark):
    assert Q.percentiles(Q.sketch(spark.createDataFrame([], DDL), ["g"], F.col("x")), ["g"]).count() == 0
