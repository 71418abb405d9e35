"""Whitening, hard negatives and source mixing against brute force, awkward rows included."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, hard_negatives, mixing, whitening

ROWS = "vec_id long, embedding array<float>, label int, n int, v string, id string, component string"


def vectors(spark, rows):
    """Rows (vec_id, embedding, label) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, None if e is None else list(map(lambda x: None if x is None else float(x), e)), label, 1, "v", "i", "c") for i, e, label in rows], ROWS)


BROKEN = [(900, None, 1), (901, [1.0, float("nan"), 0.0, 1.0], 1), (902, [1.0, float("inf"), 0.0, 1.0], 1), (903, [1.0, None, 0.0, 1.0], 1), (904, [], 1), (905, [1.0, 2.0], 1)]


def brute_whitening(x):
    x = np.floor(1024 * np.float32(x).astype(float)).astype(int) + 100_000
    n, s = len(x), x.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    return x, n, s, values[::-1], axes[:, ::-1]


def test_whitening_by_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)) * [3, 2, 1, 0.5] + [10, -4, 0, 7]
    x[100:230] = x[100]  # a third are copies
    rows = [(i, v, i % 3) for i, v in enumerate(x)] + BROKEN + [(None, x[0], None), (7, x[7], 1)]
    df = vectors(spark, rows).repartition(5)
    got = whitening.whiten(df, components=3).toPandas()
    whole, n, s, values, axes = brute_whitening([v for _, v, _ in rows[:400]] + [x[0], x[7]])
    assert len(got) == 402 * 3 and set(got.n) == {402} and got.vec_id.isna().sum() == 3
    deviations = {i: int(((n * whole[i] - s) ** 2).sum()) for i in range(400)}
    for r in got[got.vec_id.notna()].itertuples():
        assert int(r.deviation) == deviations[int(r.vec_id)]
        want = (whole[int(r.vec_id)] - s / n) @ axes[:, r.component - 1] / math.sqrt(values[r.component - 1])
        assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-9)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    assert got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    one_side = got[got.component == 1].dropna().sort_values("vec_id")  # either sign, the same for all rows
    w = (whole[one_side.vec_id.astype(int)] - s / n) @ axes[:, 0]
    assert len(set(np.sign(w * one_side.whitened))) == 1


def test_whitening_without_variance_and_without_rows(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], BROKEN[:5], [(1, [1, 2, 3], 0)], [(i, [1, 2, 3], 0) for i in range(5)]):
        got = whitening.whiten(vectors(spark, rows))
        assert got.columns == columns and got.count() == 0
    flat = whitening.whiten(vectors(spark, [(i, [i, 2 * i, 5], 0) for i in range(6)])).toPandas()  # one direction only
    assert set(flat.component) == {1} and flat.explained.iloc[0] == pytest.approx(1) and flat.identity_error.max() < 1e-9


def test_factor_and_rotations_keep_small_eigenvalues():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    values = 10.0 ** np.arange(6, -6, -1)
    matrix = (q * values) @ q.T
    factor, order = whitening.pivoted_cholesky((matrix + matrix.T) / 2)
    assert np.allclose(factor @ factor.T, matrix[np.ix_(order, order)], rtol=1e-9, atol=1e-9)
    found, axes = whitening.principal_components((matrix + matrix.T) / 2)
    assert np.allclose(found[:8], values[:8], rtol=1e-6) and np.allclose(axes[:8] @ axes[:8].T, np.eye(8), atol=1e-9)


def test_deviations_beyond_a_long_are_exact():
    y = np.asarray([[3, -4], [10**9, 10**9]])
    assert whitening.exact_deviations(y, 5, [1, 2]) == [14**2 + 22**2, (5 * 10**9 - 1) ** 2 + (5 * 10**9 - 2) ** 2]


def brute_negatives(rows, is_anchor=lambda i: i % 100 == 0):
    kept = {}
    for i, e, label in rows:
        if i is None or e is None or label is None or len(e) != 6 or any(x is None or not math.isfinite(x) for x in e):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        kept[i, label, tuple(int(math.floor(256 * float(np.float32(x)))) for x in e)] = None
    out = set()
    for a, la, va in kept:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(va, v)), i, label) for i, label, v in kept if i != a)
        for s, p, _ in [x for x in scored if x[2] == la][:5]:
            fit = [x for x in scored if x[2] != la and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out |= {(a, p, rank, n, -s, -ns) for rank, (ns, n, _) in enumerate(fit, 1)}
    return out


@pytest.mark.parametrize("chunk_rows, group_anchors", [(4096, 4096), (50, 3)])
def test_hard_negatives_by_brute_force(spark, chunk_rows, group_anchors):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 6))
    x = centres[rng.integers(0, 6, 1200)] + 0.3 * rng.normal(size=(1200, 6))
    x[300:700] = x[300]  # a vector that a third of the rows, anchors among them, have
    rows = [(i, v, int(rng.integers(0, 4))) for i, v in enumerate(x)] + [(3000, x[5], None), (None, x[5], 1), (3100, x[5], 2), (3100, x[5], 2)]
    rows += [(3200 + i, e, label) for i, (_, e, label) in enumerate(BROKEN)] + [(4200, [0.0] * 6, 1)]
    got = hard_negatives.hard_negatives(vectors(spark, rows).repartition(4), lambda key: key % 100 == 0, chunk_rows=chunk_rows, group_anchors=group_anchors)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute_negatives(rows)


def test_hard_negatives_of_few_or_no_rows(spark):
    everything = lambda key: F.lit(True)
    for rows in ([], BROKEN[:5], [(1, [1.0] * 6, 1)], [(1, [1.0] * 6, 1), (2, [1.0] * 6, 2)], [(1, [2.0] * 6, 1), (2, [1.5] * 6, 1), (3, [1.4] * 6, 3)]):
        got = {tuple(r) for r in hard_negatives.hard_negatives(vectors(spark, rows), everything).collect()}
        assert got == brute_negatives(rows, lambda i: True)
    assert hard_negatives.hard_negatives(vectors(spark, [(1, [1.0] * 6, 1)]), lambda key: key > 5).count() == 0


def test_tree_bounds_leave_out_rows_and_lose_none():
    rng = np.random.default_rng(8)
    centres = 20 * rng.normal(size=(5, 8))
    x = np.floor(100 * (centres[rng.integers(0, 5, 40)] + 0.1 * rng.normal(size=(40, 8))))
    order, parent, edge = hard_negatives.minimum_spanning_tree(x)
    assert sorted(order) == list(range(40)) and all(parent[a] < 0 or list(order).index(parent[a]) < at for at, a in enumerate(order))
    rows = np.floor(100 * (centres[rng.integers(0, 5, 500)] + 0.1 * rng.normal(size=(500, 8))))
    norms, seen = np.linalg.norm(rows, axis=1), {}
    tree = {"x": x, "norm": np.linalg.norm(x, axis=1), "parent": parent, "edge": edge, "order": order}
    limit = {a: np.sort(rows @ x[a])[-5] for a in range(40)}

    def wanted(a, low, high):
        assert (low <= rows @ x[a]).all() and (rows @ x[a] <= high).all()
        return high >= limit[a]

    scored = hard_negatives.walk(tree, rows, norms, wanted, lambda a, places, scores: seen.update({a: set(places[scores >= limit[a]])}))
    assert all(seen[a] == set(np.flatnonzero(rows @ x[a] >= limit[a])) for a in range(40))
    assert scored < 0.6 * 40 * 500


WORDS = "house river stone light green".split()


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "h", 2) for i, t, s in rows], "doc_id long, text string, source string, size int, h string, place int")


def brute_mix(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    left, target, open_ = 1.5 * sum(total.values()), {}, list(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= 2 * total[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ = [s for s in open_ if s not in full]
    out = []
    for s in names:
        start, quota = 0, math.floor(target[s] + 1e-9)
        own = sorted((hashlib.md5("/".join(["13", *([str(i)] if i is not None else []), *([t] if t is not None else [])]).encode()).hexdigest(), i, size(t)) for i, t, x in rows if x == s)
        for _, i, n in own:
            taken = n * (quota // total[s]) + max(0, min(n, quota % total[s] - start)) if total[s] else 0
            out.append((i, n, total[s], taken))
            start += n
    return out, target


@pytest.mark.parametrize("block", [7, 1024])
def test_mix_by_brute_force(spark, block):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 40))), rng.choice(["web", "web", "web", "books", "code", "", "ünï"])) for i in range(300)]
    rows += [(500, None, "web"), (501, "", "books"), (502, " \n ", None), (503, "one two", None), (504, "x " * 5000, "books"), (505, None, "empty"), (-1, "two  words", "code")]
    df = corpus(spark, rows).repartition(6)
    want, target = brute_mix(rows)
    got = mixing.mix_counts(df, block=block).collect()
    assert sorted((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in got) == sorted(want)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    source = {i: s for i, _, s in rows}
    assert all(r["target"] == pytest.approx(target[source[r["doc_id"]]]) for r in got)
    again = mixing.mix_counts(df.repartition(3), block=block).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_any_run_of_slots_holds_the_sources_near_their_shares(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(50)), "abc"[min(2, i % 7)]) for i in range(700)]
    pieces, table = mixing.mixed(corpus(spark, rows), block=20)
    found = pieces.groupBy("slot", "place").agg(F.sum("length").alias("words")).orderBy("slot").collect()
    places = [r["place"] for r in found]
    share = {p: places.count(p) / len(places) for p in set(places)}
    for at in range(0, len(places) - 256, 97):
        for p in share:
            assert abs(places[at : at + 256].count(p) - 256 * share[p]) < 12
    # a slot takes words of one source that follow each other, 20 of them but at the ends
    assert all(r["words"] <= 20 for r in found) and sum(r["words"] == 20 for r in found) > 0.95 * len(found)
    assert pieces.where("begin < 0 OR begin + length > size OR length < 1").count() == 0
    assert len({r["slot"] for r in found}) == len(found) and table.count() == 700


def test_mixes_of_nothing(spark):
    assert mixing.mix_counts(corpus(spark, [])).count() == 0
    got = mixing.mix_counts(corpus(spark, [(1, None, "a"), (1, "", None)])).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, 0.0, 0), (1, 0, 0, 0.0, 0)]
    same = mixing.mix_counts(corpus(spark, [(1, "a b c", "s")] * 4 + [(None, "d", "s")] * 2)).toPandas()  # repeated rows
    assert len(same) == 6 and same.taken.sum() == 21 and set(same.target) == {21.0}


@pytest.mark.parametrize("n", [0, 1, 4, 6, 7, 9, 15, 30])
def test_nearest_neighbours_of_small_tables_are_never_short(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 8)).astype(np.float32)
    got = ann.nearest_neighbours(vectors(spark, [(i, v, 0) for i, v in enumerate(x)]), lambda key: key >= 0).toPandas()
    if n < 2:
        assert not len(got)
        return
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for q in range(n):
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, min(5, n - 1) + 1)) and q not in set(own.vec_id)
        if n <= 6:  # all candidates
            assert own.vec_id.tolist() == [i for i in np.argsort(-(y @ y[q]), kind="stable") if i != q][:5]
