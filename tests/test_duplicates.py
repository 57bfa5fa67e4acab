import datetime as dt
import random

from frameloom.config import Config
from frameloom.operators import duplicates as D

DDL = "id string, sha256_hash string, ahash_hi bigint, ahash_lo bigint, uploaded_at timestamp, note string"
T0 = dt.datetime(2019, 3, 1)


def rows(seed, n, base=4):
    rng = random.Random(seed)
    centres = [(rng.getrandbits(32), rng.getrandbits(32)) for _ in range(base)]
    out = []
    for i in range(n):
        hi, lo = rng.choice(centres)
        for _ in range(rng.randrange(8)):
            lo ^= 1 << rng.randrange(32)
        none = rng.random() < 0.1
        out.append((f"id{i:03}", rng.choice(["a1" * 32, "a2" * 32, "A3" * 32, f"{i:064x}", None]), None if none else hi, None if none else lo, T0 + dt.timedelta(minutes=rng.randrange(40)), "x"))
    return out


def model(data, window, limit):
    """The rule read row by row: exact first, else the closest of the newest others, the newer of equals."""
    out = {}
    for r in data:
        same = sorted((o[4], o[0]) for o in data if o[1] is not None and o[1] == r[1] and o[0] != r[0])
        if same:
            out[r[0]] = ("exact", same[0][1], None)
            continue
        if r[2] is None:
            continue
        best = None
        for o in sorted((o for o in data if o[2] is not None and o[0] != r[0]), key=lambda o: (o[4], o[0]), reverse=True)[:window]:
            d = (o[2] ^ r[2]).bit_count() + (o[3] ^ r[3]).bit_count()
            if best is None or d < best[0]:
                best = (d, o[0])
        if best and best[0] <= limit:
            out[r[0]] = ("near_duplicate", best[1], best[0])
    return out


def test_snapshot_rule_equals_the_sequential_model(spark):
    for seed, window in ((1, 5), (2, 30), (3, 500)):
        data, config = rows(seed, 60), Config(near_window=window, near_distance=3)
        got = {r.id: (r.match_type, r.matched_id, r.distance) for r in D.verdicts(spark.createDataFrame(data, DDL), config).collect()}
        assert got == model(data, window, 3)


def test_upload_rule_looks_back_only(spark):
    data, config = rows(7, 80), Config(near_window=10, near_distance=3)
    got = {r.id: (r.matched_id, r.distance) for r in D.near_before_upload(spark.createDataFrame(data, DDL), config).collect()}
    order, want = sorted((r for r in data if r[2] is not None), key=lambda r: (r[4], r[0])), {}
    for i, r in enumerate(order):
        near = [((o[2] ^ r[2]).bit_count() + (o[3] ^ r[3]).bit_count(), -j, o[0]) for j, o in list(enumerate(order))[max(0, i - 10) : i]]
        if near and min(near)[0] <= 3:
            want[r[0]] = (min(near)[2], min(near)[0])
    assert got == want


def test_band_pairs_equal_brute_force(spark):
    data = rows(11, 120)
    got = sorted((r.id_a, r.id_b, r.distance) for r in D.near_pairs(spark.createDataFrame(data, DDL), 5).collect())
    classes = {}
    for r in sorted(data):
        if r[2] is not None:
            classes.setdefault((r[2], r[3]), r[0])
    want = sorted((min(a, b), max(a, b), d) for (x, a) in classes.items() for (y, b) in classes.items() if a < b and (d := (x[0] ^ y[0]).bit_count() + (x[1] ^ y[1]).bit_count()) <= 5)
    assert got == want


def test_hash_texts_count_by_their_digits(spark):
    """Halves that are missing come from the perceptual hash, and spellings of one hash are one hash."""
    ddl = "id string, sha256_hash string, perceptual_hash string, ahash_hi bigint, ahash_lo bigint, uploaded_at timestamp"
    sha, t = "ab" * 32, [T0 + dt.timedelta(hours=h) for h in range(6)]
    data = [
        ("a", sha, None, None, None, t[0]), ("b", f"SHA256:{sha.upper()} ", None, None, None, t[1]), ("c", sha[:-1] + "?", "0x00000000000000ff", None, None, t[2]),
        ("d", None, "00000000000000FE", 0, 0xFE, t[3]), ("e", None, "zz", None, None, t[4]), ("f", None, " 00000000000000fc", None, 7, t[5]),
    ]
    got = {r.id: (r.match_type, r.matched_id, r.distance) for r in D.verdicts(spark.createDataFrame(data, ddl), Config(near_distance=1)).collect()}
    assert got == {"a": ("exact", "b", None), "b": ("exact", "a", None), "c": ("near_duplicate", "d", 1), "d": ("near_duplicate", "f", 1), "f": ("near_duplicate", "d", 1)}


def test_hot_hash(spark):
    data = [(f"id{i:04}", ("ab" * 32 if i % 3 else f"{i:064x}"), None, None, T0 + dt.timedelta(minutes=i), "x") for i in range(3000)]
    got = {r.id: r.matched_id for r in D.exact_matches(spark.createDataFrame(data, DDL)).collect()}
    hot = [r[0] for r in data if r[1] == "ab" * 32]
    assert got == {i: hot[1] if i == hot[0] else hot[0] for i in hot}


def test_three_copies(spark):
    data = [(i, "c" * 64, None, None, T0 + dt.timedelta(hours=h), None) for i, h in (("b", 1), ("a", 2), ("c", 3))]
    assert {r.id: r.matched_id for r in D.exact_matches(spark.createDataFrame(data, DDL)).collect()} == {"b": "a", "a": "b", "c": "b"}


def test_empty(spark):
    empty = spark.createDataFrame([], DDL)
    assert D.verdicts(empty, Config()).count() == 0 and D.near_pairs(empty, 5).count() == 0 and D.near_before_upload(empty, Config()).count() == 0
