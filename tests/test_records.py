"""One JSON document read in many parts, against the json module."""

import json
import random

import pytest

from emberline.sources import jsonl as J
from emberline.sources.records import broken, json_records


@pytest.fixture
def small_parts(spark):
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "90")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def _accounts(n):
    rng = random.Random(4)
    odd = ['a "quoted" {brace}', "back\\slash", '\\"', "}{][", "é汉😀", "", "line\nend", "x" * 200, "}" * 30]
    return [{"username": f"u{i}", "bio": rng.choice(odd), "evidence": {"deep": [{"x": "}"}], "n": i}, "followers_count": i} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_three_forms_in_many_parts(spark, tmp_path, small_parts, indent):
    given = _accounts(40)
    array, keyed, lines = tmp_path / "a.json", tmp_path / "k.json", tmp_path / "l.jsonl"
    array.write_text(json.dumps(given, indent=indent, ensure_ascii=False), encoding="utf-8")
    keyed.write_text(json.dumps({f'k"{i}}}': x for i, x in enumerate(given)}, indent=indent), encoding="utf-8")
    lines.write_text("\n".join(json.dumps(x) for x in given), encoding="utf-8")
    want = sorted((x["username"], x["followers_count"], x["bio"]) for x in given)
    for path in (array, keyed, lines):
        got = J.read_candidates(spark, str(path))
        assert sorted((r.username, r.followers_count, r.bio) for r in got.collect()) == want
    records = json_records(spark, str(keyed), keyed=True).collect()
    assert {r.key: json.loads(r.record) for r in records} == {f'k"{i}}}': x for i, x in enumerate(given)}
    assert spark.read.option("lineSep", "}").text(str(array)).rdd.getNumPartitions() > 10


def test_other_values_and_broken_records(spark, tmp_path, small_parts):
    def read(text, keyed):
        (tmp_path / "x.json").write_text(text)
        found = json_records(spark, str(tmp_path / "x.json"), keyed)
        return sorted(((r.key, r.record) for r in found.collect()), key=str), broken(found)

    assert read("[]", False) == read(" [ ]\n", False) == read("{}", True) == read("{ }\n", True) == ([], 0)
    assert read('[1, {"a": 2}, null, "}"]\n', False) == (sorted([(None, "1"), (None, '{"a":2}'), (None, "null"), (None, "}")], key=str), 0)
    assert read('{"m": 1, "k": {"a": "}"}, "z": null}', True) == ([("k", '{"a":"}"}'), ("m", "1"), ("z", None)], 0)
    rows, bad = read('[{"a": 1}, {"a": nothing}, {"a": 3}]', False)
    assert bad == 1 and {r for _, r in rows} == {'{"a":1}', '{"a":3}', None}
    (tmp_path / "p.json").write_text('{"@A": {"followers_count": 5}, "b": null}\n')
    assert sorted(map(tuple, J.read_profiles(spark, str(tmp_path / "p.json")).collect())) == [("a", 5), ("b", None)]
