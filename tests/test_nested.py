import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from frameloom.functions.details import patient_decode, read_details, read_json
from frameloom.operators.nested import NestedReports, Subtrees

CHECK = "array<struct<`check`:string,passed:boolean,severity:string,details_json:string,message:string>>"
DDL = f"id string, analysis_result struct<overall_status:string,issues_found:array<string>,checks:{CHECK},confidence_score:double>, image_id string"


def report(*details):
    return ("flagged", ["x"], [None if d is ... else ("c", True, "none", d, "m") for d in details], 0.5)


def walk(value, path=""):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[{i}]")
    else:
        yield path, value


DETAILS = [
    '{"a":{"b":[1,null,{"c":"x"}]},"d":true}', ..., None, "", "null", "12", '"text"', "{}", "[]", '[{"a":1},{"a":[[2]]}]', '"{\\"q\\":0.5}"', '{"a":1', "[object Object]", '{"n":NaN}', '{"d":true,"a":{"b":[1,null,{"c":"x"}]}}',
]


@pytest.fixture(scope="module")
def made(spark):
    rows = [("i1", report(*DETAILS), "clash"), ("i2", report('{"a":1}'), "clash"), ("i3", None, None), ("i4", ("clean", None, None, None), None), ("i2", report('{"a":1}'), "again")]
    return NestedReports(spark.createDataFrame(rows, DDL))


def expected():
    out = []
    for image, details in (("i1", DETAILS), ("i2", ['{"a":1}']), ("i2", ['{"a":1}'])):
        for pos, d in enumerate(details):
            value = read_details(d) if d is not ... else None
            if value is not None:
                out += [(image, pos, p) for p, _ in walk(value)]
    return sorted(out)


def test_paths_and_values_match_a_plain_walk(made):
    assert sorted(map(tuple, made.paths().collect())) == expected()
    values = made.values().collect()
    assert sorted((v.image_id, v.check_pos, v.path) for v in values) == expected()
    found = {v.path: (v.value_type, v.value) for v in values if v.image_id == "i1" and v.check_pos == 0}
    assert found == {"a.b[0]": ("number", "1"), "a.b[1]": ("null", None), "a.b[2].c": ("string", "x"), "d": ("boolean", "true")}


def test_equal_subtrees_are_stored_once_and_occurrences_kept(made):
    objects, bridge = made.objects().collect(), made.bridge().collect()
    assert len({o.node for o in objects}) == len(objects)
    roots = {(d.image_id, d.check_pos): d.node for d in made.details().collect()}
    assert roots["i1", 0] == roots["i1", 14], "key order does not change an object"
    assert made.details().where("image_id = 'i2'").count() == 2
    known = {o.node: o.n_children for o in objects}
    for parent, n in known.items():
        assert sorted(b.ordinal for b in bridge if b.parent == parent) == list(range(n))
    assert all(b.child in known for b in bridge if b.child is not None)


def test_report_and_check_tables(made):
    reports = {(r.image_id, r.n_checks) for r in made.reports().collect()}
    assert ("i4", None) in reports and ("i1", len(DETAILS)) in reports and not any(i == "i3" for i, _ in reports)
    positions = [c.check_pos for c in made.checks().where("image_id = 'i1'").collect()]
    assert sorted(positions) == [i for i, d in enumerate(DETAILS) if d is not ...]


def test_empty_table(spark):
    made = NestedReports(spark.createDataFrame([], DDL))
    assert made.paths().count() == 0 and made.values().count() == 0 and made.objects().count() == 0


def test_very_deep_and_very_long_details_are_kept(spark):
    comb, bottom = '{"a":1,"b":' * 1200 + "2" + "}" * 1200, "[" * 100_000 + "7" + "]" * 100_000
    wide, long = json.dumps({"k": list(range(20_000))}), '{"n":' + "9" * 6000 + "}"
    made = NestedReports(spark.createDataFrame([("i", report("[" * 100_000 + "]" * 100_000, bottom, comb, wide, long), None)], DDL))
    paths = [(r.check_pos, r.path) for r in made.paths().collect()]
    assert sorted({p for p, _ in paths}) == [1, 2, 3, 4] and len(paths) == 1 + 1201 + 20_000 + 1
    assert (1, "[0]" * 100_000) in paths and (2, "b." * 1199 + "b") in paths and (2, "b." * 1199 + "a") in paths
    assert {v.value for v in made.values().where("check_pos = 4").collect()} == {"9" * 6000}


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=3), x, max_size=4), max_leaves=12), st.integers(0, 80), st.sampled_from(["", ",", "]", "}", '"', " ", "x", "0"]))
def test_patient_reader_equals_the_library(value, at, noise):
    text = json.dumps(value, indent=1)
    text = text[:at] + noise + text[at:]

    def read(f):
        try:
            return repr(f(text))
        except ValueError:
            return "refused"

    assert read(patient_decode) == read(lambda t: json.loads(t, parse_constant=lambda n: [][1:] or json.loads("")))


def test_what_counts_as_json():
    assert read_json("NaN") is None and read_json('{"a":Infinity}') is None and read_json('"[1]"') == [1] and read_json(None) is None and read_details("3") is None
    assert read_json("9" * 6000) == "9" * 6000 and read_details('"' + '{\\"a\\":1}' + '"') == {"a": 1}


@pytest.mark.parametrize("share", [1, 3])
def test_a_hot_subtree_is_spread_and_loses_nothing(spark, share):
    rows = [(f"i{k}", report('{"hot":{"x":[1,{"y":2}]}}' if k % share == 0 else f'{{"k":{k}}}'), None) for k in range(3000)]
    made = NestedReports(spark.createDataFrame(rows, DDL).repartition(3))
    assert sorted(map(tuple, made.paths().collect())) == sorted((i, 0, p) for i, r, _ in rows for p, _ in walk(read_details(r[2][0][3])))


def test_identity_separates_types_and_places():
    t = Subtrees()
    values = [{"a": 1}, {"a": "1"}, {"a": None}, {"a": "null"}, {"a": True}, {"a": 1.0}, [1], {"0": 1}, {"a": {}}, {"a": []}, {"a": {"b": 1}}, {"a.b": 1}]
    nodes = [t.add(v).node for v in values]
    assert len(set(nodes)) == len(values)
