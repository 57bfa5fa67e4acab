import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import filters, history, seen_keys

DDL = "id string, sha256_hash string, perceptual_hash string, uploaded_at timestamp, batch string, hash int"
T0 = dt.datetime(2019, 3, 1, 22)


def rows(seed, n=160):
    rng = random.Random(seed)
    keys = [f"{rng.getrandbits(256):064x}" for _ in range(n // 4)]
    marks = [rng.getrandbits(64) for _ in range(n // 6)]
    spell = [lambda h: h, str.upper, lambda h: f"sha256:{h}", lambda h: f" {h}\n", lambda h: h[:-1], lambda h: None]
    out = []
    for i in range(n):
        key = keys[0] if rng.random() < 0.3 else rng.choice(keys)
        mark = marks[0] if rng.random() < 0.3 else rng.choice(marks)
        for _ in range(rng.randrange(9)):
            mark ^= 1 << rng.randrange(64)
        text = rng.choice([f"{mark:016x}", f"0x{mark:016x}", f"{mark:016X} ", f"{mark:016x}"[:-2] + "??", None])
        out.append((f"i{i:04}", rng.choice(spell)(key), text, T0 + dt.timedelta(hours=rng.randrange(100)), "clash", 1))
    return out


def usable(text, digits):
    bare = "".join((text or "").lower().split()).removeprefix("sha256:").removeprefix("0x")
    return bare if len(bare) == digits and set(bare) <= set("0123456789abcdef") else None


def seen_model(data):
    met, out = set(), set()
    for r in sorted(data, key=lambda r: (r[3], r[0])):
        key = usable(r[1], 64)
        if key and key in met:
            out.add(r[0])
        met.add(key)
    return out


def near_model(data):
    out = {}
    for r in data:
        older = [o for o in data if o[3].date() < r[3].date()]
        key, mark = usable(r[1], 64), usable(r[2], 16)
        if key and any(usable(o[1], 64) == key for o in older):
            out[r[0]] = "exact"
        elif mark and any((m := usable(o[2], 16)) and (int(m, 16) ^ int(mark, 16)).bit_count() <= 5 for o in older):
            out[r[0]] = "near"
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 50_000])
def test_filter_finds_all_its_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(-(2**63), 2**63 - 1, size=n))
    made = filters.FingerprintFilter.build(keys)
    again = filters.FingerprintFilter.from_bytes(made.seed, made.block, made.to_bytes())
    assert again.contains(keys).all()
    others = np.setdiff1d(rng.integers(-(2**63), 2**63 - 1, size=200_000), keys)
    assert again.contains(others).mean() < 4 * 2.0**-16 + 1e-9 if n else not again.contains(others).any()
    assert len(made.prints) <= 1.24 * n + 60


def test_measured_rate_of_many_generations_is_the_stated_one():
    rng = np.random.default_rng(11)
    sealed = [filters.FingerprintFilter.build(np.unique(rng.integers(-(2**63), 2**63 - 1, size=3000))) for _ in range(28)]
    probes = rng.integers(-(2**63), 2**63 - 1, size=1_000_000)
    hits = np.zeros(len(probes), dtype=bool)
    for one in sealed:
        hits |= one.contains(probes)
    expected = filters.wrong_rate(28) * len(probes)
    assert abs(hits.sum() - expected) < 5 * expected**0.5


def test_filter_refuses_repeated_keys():
    with pytest.raises(ValueError):
        filters.FingerprintFilter.build(np.array([5, 5, 7]))


def test_wrong_rate_compounds():
    assert filters.wrong_rate(0) == 0 and abs(filters.wrong_rate(28) - 28 / 65536) < 1e-6


@pytest.mark.parametrize("seed", [1, 2])
def test_seen_equals_the_model(spark, seed):
    data = rows(seed)
    data.append(data[5])
    made = seen_keys.SeenKeys(spark.createDataFrame(data, DDL))
    assert {r.image_id for r in made.found().collect()} - {data[5][0]} == seen_model(data[:-1]) - {data[5][0]}
    report = {r.batch_day: r for r in made.report().collect()}
    assert all(r.wrong_answers >= 0 and 0 <= r.wrong_rate_bound < 1e-3 and 0 <= r.expected_wrong < 1 for r in report.values())
    assert 0 < max(r.generations for r in report.values()) < len(report)


def test_sealed_filters_answer_a_new_batch(spark):
    old = spark.range(0, 5000).select(F.xxhash64("id").alias("key"))
    filters_of = seen_keys.seal(old, 4).union(seen_keys.seal(spark.range(5000, 6000).select(F.xxhash64("id").alias("key")), 4))
    new = spark.range(4000, 9000).select("id", F.xxhash64("id").alias("key"))
    got = {r.id: r.maybe for r in new.join(seen_keys.probe_sealed(new, filters_of, 4), "key").collect()}
    assert len(got) == 5000 and all(got[i] for i in range(4000, 6000)) and sum(got[i] for i in range(6000, 9000)) <= 3


@pytest.mark.parametrize("seed", [3, 4])
def test_history_equals_brute_force(spark, seed):
    data = rows(seed)
    got = {r.image_id: r.match_kind for r in history.replay(spark.createDataFrame(data, DDL)).collect()}
    assert got == near_model(data) and set(got.values()) == {"exact", "near"}


@pytest.mark.parametrize("days", [1, 3, 9])
def test_incremental_steps_equal_the_replay(spark, days):
    data = rows(5)
    table = spark.createDataFrame(data, DDL)
    last = sorted({r[3].date() for r in data})[-days:]
    days_of = {r[0]: r[3].date() for r in data}
    got = {r.image_id: r.match_kind for r in history.incremental(table, days).collect()}
    assert got == {i: k for i, k in near_model(data).items() if days_of[i] in last}
    seen = {r.image_id for r in seen_keys.incremental(table, days).collect()}
    assert seen == {i for i in seen_model(data) if days_of[i] in last}


def test_an_index_keeps_its_layout_and_reads_matching_buckets_only(spark, tmp_path):
    """Written with 8 pieces, opened later: the layout comes from the folder, a probe prunes buckets, repeated steps add nothing."""
    path = str(tmp_path / "index")
    history.HistoryIndex.create(spark, path, 8, buckets=512)
    columns = "row_id string, batch int, hash string, sig bigint"
    first = spark.createDataFrame([(f"a{i}", 1, f"{i:064x}", i * 7919 << 20) for i in range(50)], columns)
    scratch = history.Scratch(spark, "test")
    assert history.HistoryIndex.open(spark, path).step(first, scratch).count() == 0
    index = history.HistoryIndex.open(spark, path)
    assert (index.pieces, index.buckets) == (8, 512)
    held = index.bands().count()
    again = spark.createDataFrame([("b", 2, f"{3:064x}", 5), ("c", 2, None, (7919 * 9 << 20) ^ 3), ("d", 2, None, None)], columns)
    probe = index.keyed(history.firsts(again, "sig"))
    pruned = index.bands().where(index._touched(probe))
    assert 0 < len(pruned.inputFiles()) and "PartitionFilters: [bucket" in pruned._jdf.queryExecution().executedPlan().toString() and pruned.count() < held / 2
    assert {r.image_id: r.match_kind for r in index.step(again, scratch).collect()} == {"b": "exact", "c": "near"}
    added = index.bands().count()
    assert added == held + 2 * held // 50
    assert {r.image_id for r in index.step(again, scratch).collect()} == {"b", "c"} and index.bands().count() == added


def test_a_store_merges_its_generations_and_still_knows_all_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(seen_keys, "GENERATIONS", 3)
    path, scratch = str(tmp_path / "store"), seen_keys.Scratch(spark, "test")
    seen_keys.SeenStore.create(spark, path, 2)
    for day in range(5):
        batch = [(f"{day}-{i}", T0 + dt.timedelta(days=day), bytes([day if i % 2 else 0, i])) for i in range(40)] + [(f"{day}-null", T0, None)]
        got = {r.image_id for r in seen_keys.SeenStore(spark, path).step(spark.createDataFrame(batch, "row_id string, seen_at timestamp, hash binary"), scratch).collect()}
        assert got == (set() if day == 0 else {f"{day}-{i}" for i in range(0, 40, 2)})
    store = seen_keys.SeenStore(spark, path)
    assert len(store.generations()) <= 3 and store.keys().count() == store.keys().distinct().count() == 20 + 5 * 20


def test_hot_keys_and_crowded_bands(spark):
    """A third of all rows share one key, and another third fingerprints that differ in few bits."""
    data = [(f"i{k:04}", "ab" * 32 if k % 3 == 0 else f"{k:064x}", f"{1 << (k % 4):016x}" if k % 3 == 1 else None, T0 + dt.timedelta(hours=k % 90), None, 1) for k in range(1500)]
    table = spark.createDataFrame(data, DDL)
    assert {r.image_id for r in seen_keys.SeenKeys(table).found().collect()} == seen_model(data)
    assert {r.image_id: r.match_kind for r in history.replay(table).collect()} == near_model(data)


@pytest.mark.parametrize("pieces", [7, 8, 9])
def test_band_keys_never_miss(spark, pieces):
    rng = random.Random(pieces)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 5):
            b ^= 1 << bit
        pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    made = spark.createDataFrame(pairs, "a bigint, b bigint").select(F.arrays_overlap(history.band_keys(F.col("a"), pieces), history.band_keys(F.col("b"), pieces)).alias("met"))
    assert made.where("not met").count() == 0


def test_pieces_grow_with_the_history():
    assert [history.pieces_for(n) for n in (0, 10**6, 10**8, 10**10)] == [7, 7, 8, 9]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DDL)
    assert seen_keys.SeenKeys(empty).found().count() == 0 and history.replay(empty).count() == 0


def test_all_hashes_null(spark):
    table = spark.createDataFrame([("a", None, None, T0, None, None), ("b", None, None, T0 + dt.timedelta(days=1), None, None), ("c", None, None, None, None, None)], DDL)
    assert seen_keys.SeenKeys(table).found().count() == 0 and history.replay(table).count() == 0
