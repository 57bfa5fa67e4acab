import random
import uuid
from functools import reduce

import pytest

from frameloom.llm import components as C


def groups(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in parent}


def run(spark, links, **kw):
    raw = spark.createDataFrame([(a and bytes.fromhex(a), b and bytes.fromhex(b), "x") for a, b in links], "a binary, b binary, label string")
    return {bytes(r.v).hex(): bytes(r.label).hex() for r in C.components(raw, **kw).collect()}


def ids(n, seed=0):
    rng = random.Random(seed)
    return [f"{rng.getrandbits(128):032x}" for _ in range(n)]


def test_star_chain_pairs_and_dirt(spark):
    v = ids(80)
    links = [(v[0], x) for x in v[1:30]] + list(zip(v[30:50], v[31:50])) + [(v[60], v[61]), (v[61], v[60]), (v[60], v[61]), (v[62], v[62]), (None, v[63]), (v[64], None)]
    assert run(spark, links) == groups(links)


def test_long_chains_cost_few_rounds(spark, monkeypatch):
    """A chain on the giant, one between two stars, and one alone; the search itself meets a few rounds only."""
    v = ids(400, 1)
    links = [(v[0], x) for x in v[1:25]] + list(zip(v[24:160], v[25:160])) + [(v[159], x) for x in v[160:170]] + list(zip(v[200:330], v[201:330])) + [(v[340], v[341]), (v[341], v[342])]
    written = []
    write = C.Scratch.write
    monkeypatch.setattr(C.Scratch, "write", lambda self, df, name, *a: written.append(name) or write(self, df, name, *a))
    assert run(spark, links) == groups(links)
    assert sum(name.startswith("reached-") for name in written) <= 8 and "rest" in written


def test_giant_is_peeled_to_its_end_and_removed(spark, monkeypatch):
    """On the largest test table the search ends by itself and what is left holds no vertex of the giant."""
    kept = {}
    write = C.Scratch.write
    monkeypatch.setattr(C.Scratch, "write", lambda self, df, name, *a: kept.setdefault(name, write(self, df, name, *a)))
    dir_ = "/root/testdata/sf0.1"
    links = C.image_links(spark.read.parquet(f"{dir_}/image.parquet"), spark.read.parquet(f"{dir_}/check_result.parquet"))
    labels = C.components(links)
    rounds = sorted((n for n in kept if n.startswith("reached-")), key=lambda n: int(n.split("-")[1]))
    giant, rest = reduce(lambda x, y: x.union(y), [kept[n] for n in rounds]), kept["rest"]
    assert kept[rounds[-1]].count() == 0 and giant.count() > 100 and rest.count() > 0
    assert C._both_ways(rest).join(giant.withColumnRenamed("v", "a"), "a").count() == 0
    assert labels.count() == labels.select("v").distinct().count()


def test_random_graph(spark):
    rng, v = random.Random(5), ids(150, 2)
    links = [(rng.choice(v), rng.choice(v)) for _ in range(110)]
    assert run(spark, links) == groups(links)


def test_chains_alone_and_a_ring(spark):
    v = ids(40, 3)
    links = list(zip(v[:12], v[1:13])) + list(zip(v[20:30], v[21:31])) + [(v[30], v[20])]
    assert run(spark, links) == groups(links)


def test_no_links(spark):
    assert run(spark, []) == {}


def test_matched_ids():
    u = str(uuid.UUID(int=2**127 + 5))
    h = u.replace("-", "")
    good = [
        f'{{"matchType":"exact","matchedImageId":"{u}"}}', f'[{{"matchType":"near_duplicate","matched_image_id":"{u.upper()}"}}]', f'{{"matchType":"exact","match":{{"imageId":"{h}"}}}}',
        f'{{"matchType":"exact","matchedImage":{{"id":"urn:uuid:{u}","status":"completed"}}}}', f'"{{\\"matchType\\":\\"exact\\",\\"matchedImageId\\":\\" {u} \\"}}"', f'{{"matchType":"exact","matchedImageId":"{{{u.upper()}}}"}}',
    ]
    assert [C.matched_ids(t) for t in good] == [[h]] * len(good)
    bad = [
        None, "", "null", "[]", "{}", "12", f'{{"matchType":"none","matchedImageId":"{u}"}}', f'{{"matchType":"exact","matchedImageId":"{u}"', f'{{"matchType":"exact","candidates":[{{"id":"{u}"}}]}}',
        '{"matchType":"exact","matchedImageId":null}', f'{{"matchType":"exact","score":NaN,"matchedImageId":"{u}"}}', f'{{"matchType":"exact","matchedImageId":"{h}00"}}', f'{{"matchedImageId":"{u}"}}', '{"matchType":"exact","match":[1]}',
    ]
    assert [C.matched_ids(t) for t in bad] == [[]] * len(bad)


def test_links_from_reports_and_runs(spark):
    a, b, c, gone = (str(uuid.UUID(int=i + 2**100)) for i in range(4))
    check = "struct<`check`:string,passed:boolean,severity:string,details_json:string,message:string>"
    said = lambda x: f'{{"matchType":"exact","matchedImageId":"{x}"}}'
    images = spark.createDataFrame(
        [(a, (None, None, [None, ("duplicate_detection", False, "high", said(b.upper()), None), ("blur_detection", False, "high", said(c), None)], None)), (b, None), (c, (None, None, None, None))],
        f"id string, analysis_result struct<overall_status:string,issues_found:array<string>,checks:array<{check}>,confidence_score:double>",
    )
    runs = spark.createDataFrame([(b, "duplicate_detection", said(b)), (c, "duplicate_detection", said(gone)), (gone, "duplicate_detection", said(c)), (None, "duplicate_detection", said(c))], "image_id string, check_name string, details_json string")
    got = [(r.a, r.b) for r in C.image_links(images, runs).select(C.id_text(C.F.col("a")).alias("a"), C.id_text(C.F.col("b")).alias("b")).collect()]
    assert got == [(a, b)]
