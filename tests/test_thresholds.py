"""Thresholds of the registered clusters and joins are the reference's: posts that are that near, and not nearer, are found."""

import pytest

from emberline.plans import ORACLE_SQL, QUERIES

duckdb = pytest.importorskip("duckdb")

#: Texts of ten words of one weight by how many they share with the first: ids are 10 + that number, so cosines are tenths.
SHARED = (10, 9, 8, 7, 5)  # none at 0.6, where rounding would decide


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    import hashlib

    where, slots, words = tmp_path_factory.mktemp("near"), set(), []
    for i in range(1000):  # a slot of the embedding each
        word = "".join(chr(97 + int(c)) for c in f"{i:05d}")
        slot = hashlib.md5(word.encode()).digest()[-1]
        if slot not in slots:
            slots.add(slot)
            words.append(word)
    base, rest = words[:10], iter(words[10:])
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    for n in SHARED:
        con.execute("INSERT INTO documents VALUES (?, ?, 'en', ?, 0)", [20 - n, " ".join([*base[:n], *(next(rest) for _ in range(10 - n))]), f"s{n}"])
    con.execute(f"COPY documents TO '{where}/documents.parquet'")
    return con, str(where)


def rows(spark, tables, name):
    con, where = tables
    got = QUERIES[name](spark, where)
    columns = sorted(got.columns)
    found = sorted(map(tuple, got.select(*columns).collect()))
    assert found == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall())
    return [dict(zip(columns, r)) for r in found]


def test_average_linkage_merges_up_to_a_distance_of_three_tenths(spark, tables):
    # 10, 11 merge at 0.9, 12 joins them at 0.76; 13 is at 0.63 on average
    assert {r["id"]: r["cluster"] for r in rows(spark, tables, "avg_linkage")} == {"10": "10", "11": "10", "12": "10", "13": "13", "15": "15"}


def test_pairs_under_conditions_reach_down_to_065(spark, tables):
    # two posts are of unlike authors and near in time; 15 is at 0.5 of the first
    assert {(r["a"], r["b"]) for r in rows(spark, tables, "constrained_pairs") if r["a"] == "10"} == {("10", b) for b in ("11", "12", "13")}


def test_density_clusters_reach_down_to_06_and_need_two_posts(spark, tables):
    # 13 is at 0.7 of the first; 15 is at 0.5 of it, at less of the others
    assert {r["id"]: r["component"] for r in rows(spark, tables, "dbscan")} == {**{str(i): "10" for i in range(10, 14)}, "15": "15"}


def test_greedy_leaders_take_posts_over_075(spark, tables):
    # 13 is at 0.7 of the first, at less of the others
    assert {r["id"]: r["leader"] for r in rows(spark, tables, "greedy_distance")} == {"10": "10", "11": "10", "12": "10", "13": "13", "15": "15"}
