"""Registered queries cover their whole table or the operator's whole job."""

import math
import random

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.operators import profile, split, train

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, cap", [("k2_pending_queue", 200), ("v17_history_filters", 100), ("s16_lookup_newest", 100)])
def test_no_row_is_cut(spark, name, cap):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{FOLDER}/orders.parquet'")
    sql = entry.oracle_sql()
    whole = sorted(tuple(r) for r in entry.queries()[f"{name}_whole"](spark, FOLDER).collect())
    assert whole == sorted(con.execute(sql[f"{name}_whole"]).fetchall())
    assert set(con.execute(sql[name]).fetchall()) <= set(whole)
    assert len(whole) > cap


def test_all_outlying_rows_unless_a_limit_is_asked_for(spark):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id < 150 THEN 1e6 + id ELSE id % 10 END AS value")
    assert sorted(r["id"] for r in profile.outlier_rows(df, ["value"], ["id"]).collect()) == list(range(150))
    assert sorted(r["id"] for r in profile.outlier_rows(df, ["value"], ["id"], per_column=20).collect()) == list(range(20))


def test_the_report_keeps_all_sections(spark):
    sections = {r["section"] for r in entry.queries()["q12_evaluation_report_whole"](spark, "/root/testdata/sf0.001").select("section").collect()}
    assert sections == {"discrimination", "calibration", "decision", "group", "disparity"}


@pytest.mark.parametrize("name, search, points", [("m6_logistic_search", "train_logistic", 24), ("m7_boosted_trees", "train_boosted", 6)])
def test_searches_cover_the_default_grids(spark, monkeypatch, name, search, points):
    class Asked(Exception):
        pass

    def asked(*data, **options):
        own = options.get("grid") or next((a for a in data if isinstance(a, dict)), {})
        default = train.LOGISTIC_GRID if points == 24 else train.BOOST_GRID
        raise Asked(math.prod(len(v) for v in {**default, **own}.values()))

    monkeypatch.setattr(train, search, asked)
    with pytest.raises(Asked) as found:
        entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert found.value.args == (points,)


@pytest.mark.parametrize("scales, copies", [((1.0, 1000.0), 0), ((1.0, 1.0, 1.0, 1.0), 40)])
def test_near_neighbours_are_those_of_brute_force(spark, scales, copies):
    rng, k = random.Random(8), 5
    x = [[rng.gauss(0, s) for s in scales] for _ in range(300)]
    x[:copies] = [x[0]] * copies
    names = [f"x{i}" for i in range(len(scales))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(x)], ["id", *names])
    got = {}
    for r in split.near_neighbours(df, names, "id", k).collect():
        got.setdefault(r["_id"], []).append(math.dist(x[r["_id"]], r["_nx"]))
    for i, p in enumerate(x):
        assert sorted(got[i]) == pytest.approx(sorted(math.dist(p, q) for j, q in enumerate(x) if j != i)[:k])


def test_neighbour_search_writes_no_pairs_and_no_pivot_distances(spark, monkeypatch):
    """What the search writes grows with the rows: no array of distances to all pivots, and few found points per row."""
    kept = {}

    def noted(df, name, write=split.written):
        kept[name] = write(df, name)
        return kept[name]

    monkeypatch.setattr(split, "written", noted)
    rng, n = random.Random(3), 900
    df = spark.createDataFrame([(i, rng.random(), rng.random()) for i in range(n)], ["id", "a", "b"])
    assert split.near_neighbours(df, ["a", "b"], "id", 5).count() == 5 * n
    assert [c for c, t in kept["cells"].dtypes if t.startswith("array") and c not in ("_x", "_ids")] == []
    assert kept["own-cells"].count() <= 6 * n


def test_near_neighbours_of_text_ids_ties_copies_and_nulls(spark):
    points = [(f"r{i:03d}", float(i % 7), float(i % 5)) for i in range(80)] + [("none", None, 1.0), ("nan", math.nan, 1.0)]
    got = {}
    for r in split.near_neighbours(spark.createDataFrame(points, "id string, a double, b double"), ["a", "b"], "id", 3).collect():
        got.setdefault(r["_id"], {})[r["rank"]] = r["_nid"]
    whole = points[:80]
    for i, a, b in whole:
        want = sorted((math.dist((a, b), (c, d)), j) for j, c, d in whole if j != i)[:3]
        assert [got[i][r] for r in (1, 2, 3)] == [j for _, j in want]
    assert len(got) == 80


def test_synthetic_parents_of_ids_that_repeat(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (1, 5.0, 5.0), (2, 1.0, 0.0), (3, 0.0, 2.0), (None, 9.0, 9.0)], "id long, a double, b double")
    made = split.smote_parents(df, ["a", "b"], "id", 20, k=2).collect()
    assert {r["_id"] for r in made} <= {1, 2, 3} and all(r["_nid"] != r["_id"] and 0 <= r["_g"] < 1 for r in made)
    # the rows of an id meet the neighbours of each other
    assert {tuple(r["_x"]) for r in made if r["_id"] == 1} == {(0.0, 0.0), (5.0, 5.0)}
