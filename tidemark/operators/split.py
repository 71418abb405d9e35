"""Splitting and balancing labelled tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.operators.ordered import content_hash, hash_number, hash_rank, literal, nth_in_order, top_k_per_key
from tidemark.session import written

MINORITY_THRESHOLD = 0.2
#: Bound of the list of pivots that every row looks through.
MAX_PIVOTS = 4096
#: Points of a block, blocks of an Arrow batch, distances held at once, and asking points that a task gathers before it passes them on.
BLOCK_POINTS = 2048
BATCH_BLOCKS = 256
STEP_CELLS = 1 << 20
HELD_ASKS = 200_000
MAX_CLASSES = 10_000


def chronological_split(
    df: DataFrame, timestamp_col: str = "timestamp", test_size: float = 0.2, tiebreak: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """First ``int(n·(1 − test_size))`` rows in time order, and the rest.

    The cut row is found from counts per time value; the split itself is then two filters,
    with no sort of the table. ``tiebreak`` must make the order total. Rows without a time come
    last, so they belong to the second part.
    """
    order = [timestamp_col, *tiebreak]
    n = df.count()
    k = int(n * (1 - test_size))
    if k >= n:
        return df, df.limit(0)
    cut = nth_in_order(df, order, k)
    before = F.lit(False)
    for c, v in zip(reversed(order), reversed(cut)):
        if v is None:
            before = F.col(c).isNotNull() | before
        else:
            limit = literal(v, df, c)
            before = F.coalesce((F.col(c) < limit) | ((F.col(c) == limit) & before), F.lit(False))
    return df.filter(before), df.filter(~before)


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class, null labels aside; a label has few values (checked), so the counts come to the driver."""
    rows = df.filter(F.col(label).isNotNull()).groupBy(label).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} values and is no class label")
    return {r[label]: r["count"] for r in rows}


def stratified_folds(df: DataFrame, label: str, id_cols: Sequence[str], n_splits: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold``: class shares are equal in all folds; k falls to the smallest class size."""
    k = min(n_splits, min(class_counts(df, label).values()))
    ranked = hash_rank(df, [label], id_cols, seed, "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def undersample(df: DataFrame, label: str, id_cols: Sequence[str], seed: int = 42, threshold: float = MINORITY_THRESHOLD) -> DataFrame:
    """Cut every class to the smallest one's size, if its share is below the threshold; rows without a label stay out of the cut."""
    counts = class_counts(df, label)
    least = min(counts.values())
    if least / sum(counts.values()) >= threshold:
        return df
    return hash_rank(df, [label], id_cols, seed, "_rank").filter(F.col(label).isNull() | (F.col("_rank") <= least)).drop("_rank")


def near_neighbours(df: DataFrame, features: Sequence[str], id_col: str, k: int = 5) -> DataFrame:
    """``(id, rank, nid, neighbour features)``: the k nearest of all other rows, exactly, ties by id."""
    near = _near_lists(df, features, id_col, k)
    return near.select("_id", F.posexplode("_near").alias("_i", "_n")).select("_id", (F.col("_i") + 1).alias("rank"), F.col("_n.nid").alias("_nid"), F.col("_n.nx").alias("_nx"))


def _near_lists(df: DataFrame, features: Sequence[str], id_col: str, k: int) -> DataFrame:
    """``(id, near)``: per row the array of its k nearest other rows as ``(rank, nid, nx)``.

    Equal rows are one point with its smallest ids. Points chosen by a hash are pivots, the
    square root of their number, and a point belongs to the cell of its nearest pivot. The
    distances to the pivots, which are points, and to the points of its own cell bound how far a
    point's k nearest can be. By the triangle inequality a cell whose pivot is farther than its
    radius plus that bound holds none of them. Asking points meet the points of the cells that
    are left block by block, and only the k + 1 nearest of a block leave the task: neither pairs
    nor distances to pivots are written. With many features few cells are left out and the work,
    not what is written, grows with the square of the points. Rows with a null or non-finite
    feature take no part.
    """
    base = df.select(F.col(id_col).alias("_id"), F.array(*[F.col(c).cast("double") for c in features]).alias("_x"))
    base = base.filter(F.forall("_x", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))))
    lowest = top_k_per_key(base.select("_id", "_x"), ["_x"], [F.asc("_id")], k + 1)
    points = lowest.groupBy("_x").agg(F.array_sort(F.collect_list("_id")).alias("_ids")).withColumn("_p", content_hash("point", F.concat_ws(",", F.col("_x").cast("array<string>"))))
    points = written(points, "points")
    n = points.count()
    first = points.orderBy("_p").limit(min(MAX_PIVOTS, max(1, math.isqrt(n)))).select("_p", "_x").collect()  # at most MAX_PIVOTS
    pivots = np.array([r["_x"] for r in sorted(first, key=lambda r: r["_p"])], dtype=float).reshape(-1, len(features))
    placed = points.mapInArrow(_placing(pivots, k), T.StructType([*points.schema, *T.StructType.fromDDL("_cell int, _far double, _to double")]))
    # copies of a point are its neighbours at no distance
    bound = F.when(F.size("_ids") > k, F.lit(0.0)).otherwise(F.col("_to")).alias("_bound")
    placed = written(placed.select("_p", "_x", "_ids", "_cell", "_far", bound), "cells")
    cells = written(placed.groupBy("_cell").agg(F.max("_far").alias("_radius"), F.ceil(F.count("*") / BLOCK_POINTS).alias("_n")), "radii")
    radii = np.full(len(pivots), -np.inf)  # a cell without points is never visited
    for r in cells.collect():  # at most MAX_PIVOTS
        radii[r["_cell"] - 1] = r["_radius"]
    # in the order of their ids, so the first of equally near points in a block is the one that counts
    block = F.pmod(F.xxhash64("_p"), "_n").alias("_block")
    dealt = placed.join(cells, "_cell").select("_cell", block, F.struct("_ids", "_x", "_p", "_bound").alias("_c"))
    blocks = dealt.groupBy("_cell", "_block").agg(F.sort_array(F.collect_list("_c")).alias("_c"))
    blocks = written(blocks.select("_cell", *[F.col(f"_c.{c}").alias(c) for c in ("_ids", "_x", "_p", "_bound")]), "blocks")
    held = blocks.select("_cell", F.col("_ids").alias("_nids"), F.col("_x").alias("_nx"))
    id_type = dict(points.dtypes)["_ids"]

    def met(asks: DataFrame) -> DataFrame:
        """Of each block that an asking point meets, the k + 1 nearest points within its bound."""
        # a row is a block of asking points and one of a cell's points
        asks.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_BLOCKS))
        pairs = asks.join(held, "_cell").select("_p", "_x", "_bound", "_nids", "_nx")
        return pairs.mapInArrow(_meeting(len(features), k), f"_p string, _gap double, _nids {id_type}, _nx array<double>")

    own = written(met(blocks.select("_cell", "_p", F.flatten("_x").alias("_x"), "_bound")), "own-cells")
    seen = own.groupBy("_p").agg(F.get(F.array_sort(F.collect_list("_gap")), F.lit(k)).alias("_seen"))
    asks = placed.filter("_bound > 0").join(seen, "_p", "left").select("_p", "_x", "_cell", F.least("_bound", "_seen").alias("_bound"))
    visits = asks.mapInArrow(_visiting(pivots, radii), "_cell int, _p array<string>, _x array<double>, _bound array<double>")
    rows = own.unionByName(met(visits)).select("_p", "_gap", F.explode("_nids").alias("_nid"), "_nx")
    found = top_k_per_key(rows, ["_p"], [F.asc("_gap"), F.asc("_nid")], k + 1)
    lists = found.groupBy("_p").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("_nid").alias("nid"), F.col("_nx").alias("nx")))).alias("_near"))
    lists = lists.join(points.select("_p", "_x"), "_p")
    return base.join(lists, "_x").select("_id", F.slice(F.filter("_near", lambda x: x["nid"] != F.col("_id")), 1, k).alias("_near"))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a to those of b, squares added in the order of the columns."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        gap = a[:, i, None] - b[None, :, i]
        gap *= gap
        total += gap
    return np.sqrt(total, out=total)


def _matrix(values: pa.Array, columns: int) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).reshape(-1, columns)


def _steps(rows: int, columns: int) -> Iterator[slice]:
    """Slices of the rows with at most ``STEP_CELLS`` distances each."""
    step = max(1, STEP_CELLS // max(columns, 1))
    return (slice(at, min(rows, at + step)) for at in range(0, rows, step))


def _placing(pivots: np.ndarray, k: int) -> Callable:
    """Adds a point's cell, the distance to its pivot, and that to the (k + 1)-th nearest pivot (one may be the point itself)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("_x").flatten(), pivots.shape[1])
            cell, far, to = np.zeros(len(x), np.int32), np.zeros(len(x)), np.full(len(x), np.inf)
            for part in _steps(len(x), len(pivots)):
                d = _distances(x[part], pivots)
                cell[part], far[part] = d.argmin(axis=1) + 1, d.min(axis=1)
                if len(pivots) > k:
                    to[part] = np.partition(d, k, axis=1)[:, k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far), pa.array(to)], [*batch.schema.names, "_cell", "_far", "_to"])

    return run


def _visiting(pivots: np.ndarray, radii: np.ndarray) -> Callable:
    """Blocks of asking points per cell that they must visit besides their own."""
    columns = pivots.shape[1]

    def blocks(parts: list[tuple]) -> pa.RecordBatch:
        cells, x, bound = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2))
        names = pa.concat_arrays([p[3] for p in parts])
        order = np.argsort(cells, kind="stable")
        cells = cells[order]
        runs = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        starts = np.concatenate([np.arange(a, b, BLOCK_POINTS) for a, b in zip(runs, np.r_[runs[1:], len(cells)])])
        ends = np.r_[starts, len(cells)].astype(np.int32)
        lists = [pa.ListArray.from_arrays(ends, names.take(pa.array(order))), pa.ListArray.from_arrays(ends * columns, x[order].ravel()), pa.ListArray.from_arrays(ends, bound[order])]
        return pa.RecordBatch.from_arrays([pa.array(cells[starts]), *lists], ["_cell", "_p", "_x", "_bound"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            x, bound = _matrix(batch.column("_x").flatten(), columns), batch.column("_bound").to_numpy()
            cell, names = batch.column("_cell").to_numpy(), batch.column("_p")
            reach = bound * (1 + 1e-9) + 1e-12  # what rounding of the distances may hide
            for part in _steps(len(x), len(pivots)):
                near = _distances(x[part], pivots) - radii <= reach[part, None]
                near[np.arange(len(near)), cell[part] - 1] = False
                row, to = np.nonzero(near)
                row += part.start
                parts.append(((to + 1).astype(np.int32), x[row], bound[row], names.take(pa.array(row))))
                held += len(row)
                if held > HELD_ASKS:
                    yield blocks(parts)
                    parts, held = [], 0
        if held:
            yield blocks(parts)

    return run


def _meeting(columns: int, k: int) -> Callable:
    """Per asking point of a block the k + 1 nearest of the other block's points within its bound; of equally near ones the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asks, xs, bounds, nids, nxs = (batch.column(i) for i in range(5))
            for i in range(batch.num_rows):
                names, ids, others = asks[i].values, nids[i].values, nxs[i].values
                x, bound, y = _matrix(xs[i].values, columns), bounds[i].values.to_numpy(), _matrix(others.flatten(), columns)
                for part in _steps(len(x), len(y)):
                    d = _distances(x[part], y)
                    keep = d <= bound[part, None]
                    if len(y) > k + 1:
                        keep &= d <= np.partition(d, k, axis=1)[:, k, None]
                        for r in np.flatnonzero(keep.sum(axis=1) > k + 1):
                            best = np.argsort(d[r], kind="stable")[: k + 1]
                            keep[r] = False
                            keep[r, best] = True
                    row, to = np.nonzero(keep)
                    at = pa.array(to)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(row + part.start)), pa.array(d[row, to]), ids.take(at), others.take(at)], ["_p", "_gap", "_nids", "_nx"])

    return run


def smote_parents(rows: DataFrame, features: Sequence[str], id_col: str, wanted: int, k: int = 5, seed: int = 42) -> DataFrame:
    """``(id, j, nid, share, x, nx)``: the parents of each of ``wanted`` synthetic rows, and how far it lies between them.

    Every row gets its copies in turn, the first rows of a seeded order one more; neighbour
    and share of a copy follow from the md5 of seed, id and copy. Rows meet the list of their
    neighbours before they are copied, so the copies are not shuffled.
    """
    n = rows.count()
    near = written(_near_lists(rows, features, id_col, k).filter(F.size("_near") > 0), "near")
    found = near.groupBy("_id").agg(F.max(F.size("_near")).alias("_k"))
    base = rows.select(F.col(id_col).alias("_id"), F.array(*[F.col(c).cast("double") for c in features]).alias("_x"))
    ranked = hash_rank(base, [], ["_id"], seed, "_r")
    copies = F.lit(wanted // n) + (F.col("_r") <= wanted % n).cast("int")
    asks = ranked.withColumn("_copies", copies).filter("_copies > 0").join(found, "_id").join(near, "_id")
    made = asks.select("_id", "_x", "_near", "_k", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_j"))
    rank = (hash_number(content_hash(seed, "_id", "_j")) % F.col("_k") + 1).cast("int")
    picked = made.select("_id", "_j", "_x", F.get("_near", rank - 1).alias("_n")).filter("_n IS NOT NULL")
    share = hash_number(content_hash(seed + 1, "_id", "_j")) / F.lit(float(1 << 32))
    return picked.select("_id", "_j", F.col("_n.nid").alias("_nid"), share.alias("_g"), "_x", F.col("_n.nx").alias("_nx"))


def smote(
    df: DataFrame, features: Sequence[str], label: str, id_col: str, k: int = 5, seed: int = 42, threshold: float = MINORITY_THRESHOLD
) -> DataFrame:
    """Original rows plus synthetic minority rows up to the largest class.

    Output has the features, the label and ``is_synthetic``. Every synthetic row lies on the
    segment between a minority row and one of its k nearest neighbours.
    """
    counts = class_counts(df, label)
    minority, n = min(counts.items(), key=lambda x: (x[1], str(x[0])))
    wanted = max(counts.values()) - n
    original = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label), F.lit(False).alias("is_synthetic"))
    if n < 2 or wanted <= 0 or n / sum(counts.values()) >= threshold:
        return original
    rows = df.filter(F.col(label) == literal(minority, df, label))
    made = smote_parents(rows, features, id_col, wanted, k, seed)
    point = F.zip_with("_x", "_nx", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    mixed = made.withColumn("_pt", point).select(
        *[(F.col("_pt")[i]["a"] + F.col("_g") * (F.col("_pt")[i]["b"] - F.col("_pt")[i]["a"])).alias(c) for i, c in enumerate(features)],
        literal(minority, df, label).alias(label),
        F.lit(True).alias("is_synthetic"),
    )
    return original.unionByName(mixed)


def train_val_test_split(
    df: DataFrame, features: Sequence[str], label: str, id_col: str, timestamp_col: str = "timestamp", test_size: float = 0.2,
    val_size: float = 0.2, balance: str | None = "smote", seed: int = 42,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Time-ordered train, validation and test parts; only the train part is balanced."""
    rest, test = chronological_split(df, timestamp_col, test_size, [id_col])
    train, val = chronological_split(rest, timestamp_col, val_size, [id_col])
    if balance == "smote":
        train = smote(train, features, label, id_col, seed=seed)
    elif balance == "undersample":
        train = undersample(train, label, [id_col], seed)
    elif balance is not None:
        raise ValueError(f"unknown method: {balance}")
    return train, val, test
