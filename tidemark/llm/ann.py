"""Nearest neighbours by inverted lists and an adaptive scan of dimensions.

Vectors are scaled to length 1 and turned by a random rotation, after which any part of the
dimensions is a fair sample of the whole distance. A list's vectors are scanned block of
columns by block: after each, a candidate whose partial distance is so large that the whole
distance hardly could be among the nearest is left out. What survives is measured exactly, on
the original vectors.

Equal vectors are one entry with its smallest ids, so many copies are one candidate. Lists and
their queries are cut into cells of bounded size, whatever share of all rows a list holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import written

NEAREST = 5
SEED = 5
#: Bound of the fit of the lists' centres: vectors with the lowest hashes.
SAMPLE_ROWS = 20_000
MAX_LISTS = 4096
#: Share of the lists that a query looks into: vectors without clear clusters need many for a recall of 0.9.
PROBED_SHARE = 0.65
BLOCK = 16
#: Deviations of the hypothesis test: a wrong rejection has a chance of about 1e-4 per block.
DEVIATIONS = 2.1
CELL_ROWS, CELL_QUERIES = 4096, 1024


def rotation(dimension: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dimension, dimension)))
    return q * np.sign(np.diag(r))


def unit_rows(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(a, b) -> float:
    """Cosine in double precision; the sums are rounded once, so equal vectors score equally."""
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def centres_of(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on a bounded sample."""
    rng = np.random.default_rng(SEED)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return centres


def scan(query: np.ndarray, rows: np.ndarray, nearest: int, block: int = BLOCK, deviations: float = DEVIATIONS) -> np.ndarray:
    """Indices of rows that may be among the nearest of the query, given both rotated and of length 1."""
    n, dimension = rows.shape
    first = min(n, 4 * nearest)
    whole = ((rows[:first] - query) ** 2).sum(axis=1)
    best = np.sort(whole)[:nearest]
    limit = best[-1] if len(best) == nearest else np.inf
    kept = [np.flatnonzero(whole <= limit + 1e-9)]
    for start in range(first, n, 512):  # the limit falls from chunk to chunk
        alive = np.arange(start, min(start + 512, n))
        partial = np.zeros(len(alive))
        for at in range(0, dimension, block):
            done = min(at + block, dimension)
            partial += ((rows[alive, at:done] - query[at:done]) ** 2).sum(axis=1)
            if done < dimension:
                fair = limit * done / dimension * (1 + deviations / math.sqrt(done)) ** 2
                near = partial <= fair + 1e-9
                alive, partial = alive[near], partial[near]
                if not len(alive):
                    break
        if len(alive):
            near = partial <= limit + 1e-9
            kept.append(alive[near])
            best = np.sort(np.concatenate([best, partial[near]]))[:nearest]
            limit = best[-1] if len(best) == nearest else np.inf
    found = np.concatenate(kept)
    whole = ((rows[found] - query) ** 2).sum(axis=1)
    return found[whole <= limit + 1e-9]


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): vectors with a key, of the table's most frequent dimension, finite, without nulls, not zero."""
    v = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    v = v.where(F.coalesce(fine, F.lit(False)))
    top = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.where(F.size("v") == (top["d"] if top else 0))


def nearest_neighbours(
    embeddings: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST, probed_share: float = PROBED_SHARE, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's nearest rows by cosine, its own row left out.

    ``is_query`` is a condition on the key. Ties go to the smaller id. Vectors that are null,
    zero, or hold null or non-finite components take no part, nor do those of another dimension
    than most. A query looks into the nearest lists, a share of all, and further ones while these
    hold no more than ``nearest`` rows, so it is short of rows only if the table is. A query with fewer candidates has fewer rows. Rows that share a key and a vector
    are one; with the same key and other vectors each is a candidate and a query of its own.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings, key, vector).distinct()
    # an entry per different vector, with its nearest + 1 smallest ids: a query's own may be among them
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= nearest + 1)
    entries = ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("entry", F.xxhash64("v", F.col("ids")[0]))
    entries = written(entries, "vector-entries")
    asked = rows.where(is_query(F.col("id"))).select("id", "v")
    total = entries.count()
    if not total:
        return spark.createDataFrame([], f"query_id {dict(rows.dtypes)['id']}, rank int, vec_id {dict(rows.dtypes)['id']}, score double")
    lists = max(1, min(MAX_LISTS, sample_rows // 8, round(math.sqrt(total))))
    sample = entries.orderBy("entry").limit(sample_rows).select("v").toArrow()["v"].combine_chunks()
    dimension = len(sample[0])
    turn = rotation(dimension)
    points = np.asarray(sample.flatten(), np.float64).reshape(-1, dimension)
    centres = centres_of(unit_rows(points) @ turn, lists)
    shared = spark.sparkContext.broadcast(centres)  # at most MAX_LISTS rows
    width = max(1, math.ceil(probed_share * len(centres)))

    @F.pandas_udf("int")
    def list_of(v: pd.Series) -> pd.Series:
        return pd.Series(np.argmax(unit_rows(v) @ turn @ shared.value.T, axis=1).astype(np.int32)) if len(v) else pd.Series([], dtype=np.int32)

    @F.pandas_udf("array<int>")
    def lists_near(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        order = np.argsort(-(unit_rows(v) @ turn @ shared.value.T), axis=1, kind="stable").astype(np.int32)
        # on small tables more lists than the share, until they hold enough rows; all if none do
        short = (np.cumsum(held[order], axis=1) <= nearest).sum(axis=1)
        return pd.Series([row[: max(width, n + 1)] for row, n in zip(order, short, strict=True)])

    listed = written(entries.withColumn("list", list_of("v")), "inverted-lists")
    held = np.zeros(len(centres), np.int64)  # ids kept in each list, of at most MAX_LISTS
    for r in listed.groupBy("list").agg(F.sum(F.size("ids")).alias("n")).collect():
        held[r["list"]] = r["n"]
    # one search per different vector that is asked for, however many rows ask for it
    name = F.md5(F.concat_ws(",", F.col("v").cast("array<string>")))
    queries = asked.select("v").distinct().select(name.alias("q"), F.hash("v").alias("qh"), F.col("v").alias("qv"))
    queries = written(queries.withColumn("list", F.explode(lists_near("qv"))), "probes")
    sizes = listed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).join(queries.groupBy("list").agg(F.count(F.lit(1)).alias("m")), "list")
    cut = F.broadcast(sizes.select("list", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("rc"), F.ceil(F.col("m") / CELL_QUERIES).cast("int").alias("qc")))  # at most MAX_LISTS rows
    cells = listed.join(cut, "list").select("list", F.pmod("entry", F.col("rc")).cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.col("qc") - 1)).alias("c"), "entry", "ids", "v")
    probes = queries.join(cut, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("rc") - 1)).alias("r"), F.pmod("qh", F.col("qc")).cast("int").alias("c"), "q", "qv")

    def search(candidates: pd.DataFrame, probing: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(candidates) and len(probing):
            turned, asked_for = unit_rows(candidates["v"]) @ turn, unit_rows(probing["qv"]) @ turn
            vectors, ids = candidates["v"].tolist(), candidates["ids"].tolist()
            for q, original, query in zip(probing["q"], probing["qv"], asked_for, strict=True):
                scored = sorted(((cosine(original, vectors[i]), i) for i in scan(query, turned, nearest + 1)), reverse=True)
                edge = scored[min(nearest, len(scored) - 1)][0]
                found += [(q, list(ids[i]), s) for s, i in scored if s >= edge]
        return pd.DataFrame(found, columns=["q", "ids", "score"])

    hits = probes_in_cells(cells, probes, search)
    hits = hits.withColumn("r", F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("r") <= nearest + 1).select("q", "score", F.explode("ids").alias("vec_id"))
    per_vector = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = hits.withColumn("r", F.row_number().over(per_vector)).where(F.col("r") <= nearest + 1).select("q", "vec_id", "score")
    answers = asked.select(F.col("id").alias("query_id"), name.alias("q")).join(top, "q").where(F.col("query_id") != F.col("vec_id"))
    place = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", place).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def probes_in_cells(cells: DataFrame, probes: DataFrame, search) -> DataFrame:
    """Run ``search`` on the candidates and the probes of each cell; both are bounded by the cell sizes."""
    by = ["list", "r", "c"]

    def pair(_, left: Iterator[pd.DataFrame] | pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return search(left, right)

    return cells.groupBy(*by).cogroup(probes.groupBy(*by)).applyInPandas(pair, "q string, ids array<long>, score double")
