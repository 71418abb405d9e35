"""Hard-negative mining with bounds along a spanning tree of the anchors.

Anchors are dealt to groups of bounded size, and a group is tied into a minimum spanning tree.
The score of a row at an anchor differs from that at the anchor's parent by at most the edge's
length times the row's norm. So scores, or bounds of scores, at the parent bound those at the
child, and only rows whose bounds reach into what is sought are scored: for positives, what may
be among the best of the anchor's label; for negatives, the window below a positive.

Rows are dealt to chunks of bounded size by a hash, whatever share of them a label or a vector
holds. A task searches one chunk for one group of anchors; what it finds is merged by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import finite_vectors
from tidemark.session import written

POSITIVES = NEGATIVES = 5
SCALE = 256
#: A negative's score lies between this percentage of the positive's and the whole of it.
LOW_PERCENT = 80
CHUNK_ROWS, GROUP_ANCHORS = 4096, 4096
#: Rows of a chunk whose bounds are kept at once, per open anchor of the tree.
STRIP = 2048
#: Below this, sums of whole numbers are exact in doubles.
EXACT = float(1 << 52)


def prepared(embeddings: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, v): the rows that take part, components as whole numbers, equal rows once.

    Components are held where the product of two vectors still fits a long.
    """
    rows = finite_vectors(embeddings, key, vector, F.col(label).cast("long").alias("label")).where(F.col("id").isNotNull() & F.col("label").isNotNull())
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    most = F.floor(F.sqrt(F.lit(float(1 << 62)) / F.size("v"))).cast("double")
    whole = F.transform("v", lambda x: F.greatest(F.least(F.floor(x * SCALE).cast("double"), most), -most).cast("long"))
    return rows.select(F.col("id").cast("long").alias("id"), moved.alias("label"), whole.alias("v")).distinct()


def products(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly; both as doubles where that is exact."""
    return (rows @ anchor).astype(np.int64)


def minimum_spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge): anchors with parents first, each one's parent (-1: the root) and the edge's length.

    A subtree is finished before the next begins, the largest child last, so that only few
    anchors wait for children at a time.
    """
    n = len(x)
    norms = (x**2).sum(axis=1)
    best, parent = np.full(n, np.inf), np.full(n, -1)
    left = np.ones(n, bool)
    at, joined = 0, []
    for _ in range(n):  # Prim: the nearest anchor outside is tied next
        left[at] = False
        joined.append(at)
        d = np.maximum(norms + norms[at] - 2 * (x @ x[at]), 0)
        nearer = left & (d < best)
        best[nearer], parent[nearer] = d[nearer], at
        if left.any():
            at = int(np.argmin(np.where(left, best, np.inf)))
    size, children = np.ones(n, np.int64), [[] for _ in range(n)]
    for a in reversed(joined[1:]):
        size[parent[a]] += size[a]
        children[parent[a]].append(a)
    order, open_ = [], [0] if n else []
    while open_:
        a = open_.pop()
        order.append(a)
        open_ += sorted(children[a], key=lambda c: -size[c])  # the smallest is popped first
    edge = np.asarray([0.0 if p < 0 else math.sqrt(((x[a] - x[p]) ** 2).sum()) for a, p in enumerate(parent)])
    return np.asarray(order, np.int64), parent, edge


def walk(anchors: dict, rows: np.ndarray, norms: np.ndarray, wanted: Callable, found: Callable) -> int:
    """Visit the anchors along their tree; returns how many scores were computed.

    ``wanted(a, low, high)`` marks the rows whose score at anchor ``a`` is needed, given bounds;
    ``found(a, places, scores)`` takes them.
    """
    x, norm, parent, edge = anchors["x"], anchors["norm"], anchors["parent"], anchors["edge"]
    waiting = np.bincount(parent[parent >= 0], minlength=len(x))
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    scored = 0
    for a in anchors["order"]:
        p = parent[a]
        own = norm[a] * norms * (1 + 1e-9) + 1  # no score exceeds the product of the norms
        if p < 0:
            low, high = -own, own
        elif edge[a] == 0:  # the same vector: the same bounds
            low, high = bounds[p][0].copy(), bounds[p][1].copy()
        else:
            reach = edge[a] * norms * (1 + 1e-9) + 1
            low, high = np.maximum(bounds[p][0] - reach, -own), np.minimum(bounds[p][1] + reach, own)
        if p >= 0:
            waiting[p] -= 1
            if not waiting[p]:
                del bounds[p]
        mark = wanted(a, low, high)
        places = np.flatnonzero(mark)
        if len(places):
            known = low[places] == high[places]  # scores that the same vector had
            scores = low[places].astype(np.int64)
            new = places[~known]
            if len(new):
                scores[~known] = products(rows if len(new) == len(rows) else rows[new], x[a])
                low[new] = high[new] = scores[~known]
                scored += len(new)
            found(a, places, scores)
        if waiting[a]:
            bounds[a] = low, high
    return scored


class Best:
    """The best few (score, id) seen: higher scores first, ties by the smaller id."""

    def __init__(self, count: int):
        self.count, self.scores, self.ids = count, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> float:
        """A score that a row must reach to matter."""
        return self.scores[-1] if len(self.scores) == self.count else -math.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        first = np.lexsort((ids, -scores))[: self.count]
        self.scores, self.ids = scores[first], ids[first]


def _matrix(frame: pd.DataFrame, cell: str = "v") -> np.ndarray:
    x = np.stack([np.asarray(v, np.int64) for v in frame[cell]])
    return x.astype(np.float64) if len(x) and (np.abs(x).max(initial=0).astype(float) ** 2) * x.shape[1] < EXACT else x


def _packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.int64).tobytes()


def packed_chunks(rows: DataFrame, chunks: int) -> DataFrame:
    """One row per chunk: (chunk, n, ids, labels, vectors), at most about ``CHUNK_ROWS`` rows in each."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": part["chunk"][:1], "n": [len(part)], "ids": [_packed(part["id"])], "labels": [_packed(part["label"])], "vectors": [_packed(np.stack(part["v"]))]})

    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "v"), F.lit(chunks)).cast("int"))
    return dealt.groupBy("chunk").applyInPandas(pack, "chunk int, n int, ids binary, labels binary, vectors binary")


def packed_groups(rows: DataFrame, groups: int) -> DataFrame:
    """One row per group of anchors with its spanning tree."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", "label", "a"])
        order, parent, edge = minimum_spanning_tree(_matrix(part).astype(np.float64))
        return pd.DataFrame({
            "group": part["group"].to_numpy()[:1], "n": [len(part)], "ids": [_packed(part["id"])], "labels": [_packed(part["label"])], "names": [_packed(part["a"])],
            "vectors": [_packed(np.stack(part["v"]))], "order": [_packed(order)], "parent": [_packed(parent)], "edge": [edge.tobytes()],
        })

    dealt = rows.withColumn("group", F.pmod("a", F.lit(groups)).cast("int"))
    return dealt.groupBy("group").applyInPandas(pack, "group int, n int, ids binary, labels binary, names binary, vectors binary, order binary, parent binary, edge binary")


def _unpacked(row: pd.Series) -> dict:
    ids, labels, x = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "vectors"))
    x = x.reshape(row["n"], -1)
    out = {"ids": ids, "labels": labels, "x": x}
    if "order" in row:
        out |= {c: np.frombuffer(row[c], np.int64) for c in ("names", "order", "parent")} | {"edge": np.frombuffer(row["edge"], np.float64)}
    return out


def _in_doubles(a: dict, c: dict) -> None:
    """Both matrices as doubles where every product is exact in them, and the norms."""
    largest = float(np.abs(a["x"]).max(initial=0)) * float(np.abs(c["x"]).max(initial=0)) * a["x"].shape[1]
    for side in (a, c):
        y = side["x"].astype(np.float64)
        side["norm"] = np.sqrt((y**2).sum(axis=1))
        if largest < EXACT:
            side["x"] = y


def search_positives(a: dict, c: dict, count: int) -> list[tuple]:
    best = [Best(count) for _ in a["ids"]]
    for at in range(0, len(c["ids"]), STRIP):
        ids, labels, x, norms = (c[k][at : at + STRIP] for k in ("ids", "labels", "x", "norm"))

        def wanted(i, low, high):
            return (labels == a["labels"][i]) & (ids != a["ids"][i]) & (high >= best[i].least)

        walk(a, x, norms, wanted, lambda i, places, scores: best[i].add(scores, ids[places]))
    return [(int(a["ids"][i]), int(a["names"][i]), int(d), int(s)) for i, b in enumerate(best) for s, d in zip(b.scores, b.ids, strict=True)]


def search_negatives(a: dict, c: dict, sought: dict, count: int, low_percent: int) -> list[tuple]:
    """``sought``: for each anchor's name, its positives as (score, rank)."""
    per = [[(p, rank, -(-low_percent * p // 100), Best(count)) for p, rank in sought.get(int(name), ()) if p >= 0] for name in a["names"]]
    for at in range(0, len(c["ids"]), STRIP):
        ids, labels, x, norms = (c[k][at : at + STRIP] for k in ("ids", "labels", "x", "norm"))

        def wanted(i, low, high):
            needed = np.zeros(len(ids), bool)
            for p, _, floor, best in per[i]:
                needed |= (high >= max(floor, best.least)) & (low <= p)
            return needed & (labels != a["labels"][i])

        def found(i, places, scores):
            for p, _, floor, best in per[i]:
                inside = (scores >= max(floor, best.least)) & (scores <= p)
                if inside.any():
                    best.add(scores[inside], ids[places[inside]])

        walk(a, x, norms, wanted, found)
    return [(int(a["ids"][i]), int(a["names"][i]), rank, int(d), int(s)) for i, own in enumerate(per) for _, rank, _, b in own for s, d in zip(b.scores, b.ids, strict=True)]


def in_cells(groups: DataFrame, chunks: DataFrame, search: Callable, schema: str, more: DataFrame | None = None) -> DataFrame:
    """Run ``search(anchors, rows, more)`` for every group and chunk; each cell is a key of its own."""
    n_groups, n_chunks = groups.agg(F.max("group") + 1).first()[0], chunks.agg(F.max("chunk") + 1).first()[0]
    if more is not None:
        groups = groups.join(more, "group", "left")
    left = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    right = chunks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        hits = []
        if len(a) and len(c):
            group, chunk = _unpacked(a.iloc[0]), _unpacked(c.iloc[0])
            _in_doubles(group, chunk)
            hits = search(group, chunk, a.iloc[0])
        return pd.DataFrame(hits, columns=columns)

    return left.groupBy("group", "chunk").cogroup(right.groupBy("group", "chunk")).applyInPandas(run, schema)


def hard_negatives(
    embeddings: DataFrame, is_anchor: Callable[[Column], Column], positives: int = POSITIVES, negatives: int = NEGATIVES, low_percent: int = LOW_PERCENT, key: str = "vec_id", vector: str = "embedding",
    label: str = "label", chunk_rows: int = CHUNK_ROWS, group_anchors: int = GROUP_ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on the key. Every anchor is searched against all rows. Rows
    without key, label or vector, with a null or non-finite component, or of another dimension
    than most have (ties: the smaller) take no part; equal rows are one; rows that share a
    key but not their vector or label are rows of their own, and none of them is another's
    positive. An anchor without positives, and a positive whose window holds no row, has no row
    in the result. Ties go to the smaller key. Other columns are left out.
    """
    spark = embeddings.sparkSession
    rows = written(prepared(embeddings, key, vector, label), "mining-rows")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if sizes is None:
        return spark.createDataFrame([], empty)
    rows = rows.where(F.size("v") == sizes["d"])
    anchors = rows.where(is_anchor(F.col("id"))).withColumn("a", F.xxhash64("id", "label", "v"))
    asked = anchors.count()
    if not asked:
        return spark.createDataFrame([], empty)
    chunks = written(packed_chunks(rows, -(-sizes["count"] // chunk_rows)), "mining-chunks")
    groups = written(packed_groups(anchors, -(-asked // group_anchors)), "mining-anchors")

    hits = in_cells(groups, chunks, lambda a, c, _: search_positives(a, c, positives), "anchor_id long, a long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id", "a").orderBy(F.desc("positive_score"), "positive_id")
    best = written(hits.withColumn("p", F.row_number().over(order)).where(F.col("p") <= positives), "mining-positives")
    # the positives of a group of anchors, as one list beside it: at most group size x positives
    group = F.pmod("a", F.lit(-(-asked // group_anchors))).cast("int")
    sought = best.groupBy(group.alias("group")).agg(F.collect_list(F.struct("a", "positive_score", "p")).alias("sought"))

    def negatives_of(a: dict, c: dict, row: pd.Series) -> list[tuple]:
        per: dict[int, list] = {}
        for s in row["sought"] if row["sought"] is not None else ():
            per.setdefault(s["a"], []).append((s["positive_score"], s["p"]))
        return search_negatives(a, c, per, negatives, low_percent)

    mined = in_cells(groups, chunks, negatives_of, "anchor_id long, a long, p int, negative_id long, negative_score long", sought)
    order = Window.partitionBy("anchor_id", "a", "p").orderBy(F.desc("negative_score"), "negative_id")
    mined = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return mined.join(best, ["anchor_id", "a", "p"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
