"""Operators that need an order: running sums, exact percentiles, lag and fill per key.

Each has a form in which no task holds a whole key, so that one key (or the global
"no key" case) may own a third of all rows:

* rows, or counts of distinct values, are dealt to ranges in their order by
  ``repartitionByRange`` and written once with the number of their range, because the ranges of
  a recomputed sample may differ;
* a running sum is a sum inside a range plus the totals of the key's earlier ranges, a filled
  value or a difference comes from the range or from the last value before it;
* percentiles are read off the running counts in those ranges that hold the asked ranks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.common import col
from tidemark.session import checkpointed, written


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that matches null keys, keeping the left copy of each key."""
    if not keys:
        return attach(left, right)
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = None
    for k in keys:
        match = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = match if on is None else on & match
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def attach(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table (an ungrouped aggregate) as a scalar subquery."""
    names = row.columns
    cell = row.select(F.struct(*[F.col(c) for c in names]).alias("_s")).scalar()
    return df.withColumn("_s", cell).select(*df.columns, *[F.col(f"_s.{c}").alias(c) for c in names])


def keyed_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows to a table of one row per key (``how``: inner or left).

    A plain equi-join: adaptive execution splits the partitions of keys that own a large share
    of the rows, by their measured bytes. ``session`` asks for that split also where the join
    feeds an aggregate on the same key, at the price of one more exchange there; a session made
    otherwise must set ``spark.sql.adaptive.forceOptimizeSkewedJoin``.
    """
    return big.join(small, list(keys), how)


def in_ranges(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """The rows, written once, with ``_range``: ranges of bounded size that follow each other in the order."""
    return written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")


def _per_key(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*(keys or [F.lit(0)]))


def range_totals(ranged: DataFrame, keys: Sequence[str], measures: Sequence[str], descending: bool = False) -> DataFrame:
    """One row per key and range: ``_in_<m>`` of the range, ``_before_<m>`` of the key's ranges before it, ``total_<m>`` of the key."""
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(m).alias(f"_in_{m}") for m in measures])
    earlier = _per_key(keys).orderBy(F.desc("_range") if descending else F.asc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(f"_in_{m}").over(earlier), F.lit(0)).alias(f"_before_{m}") for m in measures]
    return totals.select("*", *before, *[F.sum(f"_in_{m}").over(_per_key(keys)).alias(f"total_{m}") for m in measures])


def _accumulated(ranged: DataFrame, totals: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str], descending: bool = False) -> DataFrame:
    """The rows of the ranges in ``totals`` with ``cum_<m>``."""
    joined = _null_safe_join(ranged, totals, [*keys, "_range"])
    inside = Window.partitionBy(*keys, "_range").orderBy(F.desc(value) if descending else F.asc(value)).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select("*", *[(F.sum(m).over(inside) + F.col(f"_before_{m}")).alias(f"cum_{m}") for m in measures])


def running_totals(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    measures: Sequence[str],
    descending: bool = False,
) -> DataFrame:
    """Add ``cum_<m>``, the sum of ``m`` over values up to and including this row's, and ``total_<m>``, over all of the key.

    ``counts`` must hold one row per (keys, value), i.e. be aggregated first, so that ties
    share one row.
    """
    keys = list(keys)
    ranged = in_ranges(counts, [*keys, value])
    out = _accumulated(ranged, range_totals(ranged, keys, measures, descending), keys, value, measures, descending)
    return out.select(*counts.columns, *[f"cum_{m}" for m in measures], *[f"total_{m}" for m in measures])


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    probs: Sequence[float],
    name: str = "q",
) -> DataFrame:
    """Exact linearly interpolated quantiles per key as ``array<double>``; nulls ignored.

    The built-in ``percentile`` would keep every distinct value of a group in one task. Here
    the distinct values are counted once and dealt to ranges; only the ranges that hold an asked
    rank are ordered. The results are the same.
    """
    return ranged_quantiles(counted_in_ranges(df, keys, value), keys, probs, name)


def counted_in_ranges(df: DataFrame, keys: Sequence[str], value: str | Column) -> DataFrame:
    """``(keys, _v, _n, _range)``: the distinct non-null values per key as doubles, counted and dealt to ranges."""
    data = df.select(*keys, col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    return in_ranges(data.groupBy(*keys, "_v").agg(F.count("*").alias("_n")), [*keys, "_v"])


def ranged_quantiles(ranged: DataFrame, keys: Sequence[str], probs: Sequence[float], name: str = "q") -> DataFrame:
    """Quantiles of values that ``counted_in_ranges`` has dealt."""
    keys = list(keys)
    places = [(F.col("total__n") - 1) * F.lit(float(p)) for p in probs]
    ranks = [side(h) for h in places for side in (F.floor, F.ceil)]
    holds = [(F.col("_before__n") <= r) & (r < F.col("_before__n") + F.col("_in__n")) for r in ranks]
    asked = range_totals(ranged, keys, ["_n"]).filter(reduce(or_, holds))
    run = _accumulated(ranged, asked, keys, "_v", ["_n"])
    picks = [F.min(F.when(F.col("cum__n") > r, F.col("_v"))).alias(f"_at{i}") for i, r in enumerate(ranks)]
    picked = run.groupBy(*keys).agg(F.max("total__n").alias("total__n"), *picks)
    cells = [F.col(f"_at{2 * i}") + (F.col(f"_at{2 * i + 1}") - F.col(f"_at{2 * i}")) * (h - F.floor(h)) for i, h in enumerate(places)]
    return picked.select(*keys, F.array(*cells).alias(name))


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``(column_name, q)`` for several columns, through one long shuffle of distinct values."""
    return exact_quantiles(long_values(df, columns), ["column_name"], "value", probs)


def long_values(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``keys + (column_name, value)``, one row per cell of the numeric columns."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    return df.select(*keys, F.inline(cells))


def group_agg(
    df: DataFrame,
    keys: Sequence[str],
    aggs: Sequence[Column],
    medians: dict[str, Column] | None = None,
) -> DataFrame:
    """Aggregates plus exact medians per key, joined by key."""
    out = df.groupBy(*keys).agg(*aggs)
    if not medians:
        return out
    cells = F.array(*[F.struct(F.lit(n).alias("_name"), e.cast("double").alias("_value")) for n, e in medians.items()])
    mid = exact_quantiles(df.select(*keys, F.inline(cells)), [*keys, "_name"], "_value", [0.5])
    wide = mid.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.element_at("q", 1))).alias(n) for n in medians])
    return _null_safe_join(out, wide, keys, "left")


def successive_differences(
    df: DataFrame, id_col: str, ts_col: str, value: str, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """``value - previous value`` per id in time order, as sums that need no whole-id sort.

    Returns per id: ``n_diff``, ``sum_diff``, ``sum_sq_diff`` and ``n_over_50`` (|diff| > 50).
    Differences inside a range of (id, time) come from a window over that range; those across
    ranges come from the first and last value of each.
    """
    data = df.filter(F.col(value).isNotNull() & F.col(id_col).isNotNull()).select(
        id_col, F.struct(ts_col, *tiebreak).alias("_o"), F.col(value).cast("double").alias("_v")
    )
    data = in_ranges(data, [id_col, "_o"]).withColumnRenamed("_range", "_c")
    inner = Window.partitionBy(id_col, "_c").orderBy("_o")
    chunks = (
        data.withColumn("_d", F.col("_v") - F.lag("_v").over(inner))
        .groupBy(id_col, "_c")
        .agg(
            F.min_by("_v", "_o").alias("_first"),
            F.max_by("_v", "_o").alias("_last"),
            F.count("_d").alias("_n"),
            F.coalesce(F.sum("_d"), F.lit(0.0)).alias("_s"),
            F.coalesce(F.sum(F.col("_d") * F.col("_d")), F.lit(0.0)).alias("_ss"),
            F.count(F.when(F.abs("_d") > 50, 1)).alias("_o50"),
        )
    )
    outer = Window.partitionBy(id_col).orderBy("_c")
    step = F.col("_first") - F.lag("_last").over(outer)
    return (
        chunks.withColumn("_b", step)
        .groupBy(id_col)
        .agg(
            (F.sum("_n") + F.count("_b")).alias("n_diff"),
            (F.sum("_s") + F.coalesce(F.sum("_b"), F.lit(0.0))).alias("sum_diff"),
            (F.sum("_ss") + F.coalesce(F.sum(F.col("_b") * F.col("_b")), F.lit(0.0))).alias("sum_sq_diff"),
            (F.sum("_o50") + F.count(F.when(F.abs("_b") > 50, 1))).alias("n_over_50"),
        )
    )


def running_count_by_time(
    df: DataFrame, id_col: str, ts_col: str, flag: Column, name: str, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """Add ``name``: rows with ``flag`` up to and including this one, per id in time order (rows without an id: left out)."""
    data = df.filter(F.col(id_col).isNotNull()).withColumn("_f", F.coalesce(flag, F.lit(False)).cast("long"))
    data = in_ranges(data, [id_col, ts_col, *tiebreak])
    totals = range_totals(data, [id_col], ["_f"]).select(id_col, "_range", "_before__f")
    inner = Window.partitionBy(id_col, "_range").orderBy(ts_col, *tiebreak).rowsBetween(Window.unboundedPreceding, 0)
    counted = data.join(totals, [id_col, "_range"]).withColumn(name, F.sum("_f").over(inner) + F.col("_before__f"))
    return counted.select(*df.columns, name)


def longest_run(
    df: DataFrame, id_col: str, ts_col: str, flag: Column, name: str, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """Longest run of consecutive flagged rows per id (0 when none)."""
    flag = F.coalesce(flag, F.lit(False))
    data = df.select(id_col, ts_col, *[t for t in tiebreak if t not in (id_col, ts_col)], flag.alias("_flag"))
    islands = running_count_by_time(data, id_col, ts_col, ~F.col("_flag"), "_island", tiebreak)
    runs = islands.groupBy(id_col, "_island").agg(F.sum(F.col("_flag").cast("long")).alias("_len"))
    return runs.groupBy(id_col).agg(F.max("_len").alias(name))


def forward_fill(
    df: DataFrame,
    id_col: str | None,
    ts_col: str,
    columns: Sequence[str],
    tiebreak: Sequence[str] = (),
    limit: int | None = None,
    backward: bool = False,
) -> DataFrame:
    """Carry the last (or, backward, the next) non-null value of each column within an id.

    ``id_col=None`` is the ungrouped form: one ordered series over all rows. A value from an
    earlier range of (id, time) reaches a row through the table of ranges, so no id, and no day
    of an id, is ever sorted in one task. ``limit`` bounds how many nulls in a row are filled.
    ``ts_col`` plus ``tiebreak`` must order the rows of an id fully; a null time sorts first.
    """
    keys = [id_col] if id_col else []
    order = [ts_col, *tiebreak]
    data = in_ranges(df, [*keys, *order]).withColumnRenamed("_range", "_c")
    direction = F.desc if backward else F.asc
    inner = Window.partitionBy(*keys, "_c").orderBy(*[direction(c) for c in order])
    if limit is not None:
        data = data.withColumn("_local_pos", F.row_number().over(inner))
        sizes = data.groupBy(*keys, "_c").agg(F.count("*").alias("_n"))
        prior_rows = _per_key(keys).orderBy(direction("_c")).rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select(*keys, "_c", F.coalesce(F.sum("_n").over(prior_rows), F.lit(0)).alias("_offset"))
        data = _null_safe_join(data, offsets, keys + ["_c"]).withColumn("_pos", F.col("_local_pos") + F.col("_offset"))
    else:
        data = data.withColumn("_pos", F.lit(0))
    pick = F.min_by if backward else F.max_by
    cell = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("_pos").alias("p"))) for c in columns}
    at = F.struct(*order)
    summary = data.groupBy(*keys, "_c").agg(
        *[pick(cell[c], F.when(F.col(c).isNotNull(), at)).alias(f"_s_{c}") for c in columns]
    )
    prior = _per_key(keys).orderBy(direction("_c")).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys, "_c", *[F.last(f"_s_{c}", ignorenulls=True).over(prior).alias(f"_k_{c}") for c in columns]
    )
    here = inner.rowsBetween(Window.unboundedPreceding, 0)
    data = data.select("*", *[F.last(cell[c], ignorenulls=True).over(here).alias(f"_l_{c}") for c in columns])
    joined = _null_safe_join(data, carried, keys + ["_c"], "left")
    filled = {}
    for c in columns:
        source = F.coalesce(F.col(f"_l_{c}"), F.col(f"_k_{c}"))
        value = source["v"]
        if limit is not None:
            value = F.when(F.col("_pos") - source["p"] <= limit, value)
        filled[c] = F.coalesce(F.col(c), value)
    return joined.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def trailing(df: DataFrame, id_col: str, ts_col: str, days: int | None = None, marks: Sequence[int] = ()) -> DataFrame:
    """Rows within ``days`` of each id's own latest time (inclusive).

    With ``marks`` no row is dropped; a boolean ``in_<d>d`` is added per entry instead. The
    latest time per id is an aggregate joined back, not a window, so a hot id stays split.
    """
    data = df.filter(F.col(id_col).isNotNull())
    latest = data.groupBy(id_col).agg(F.max(ts_col).alias("_latest"))
    out = keyed_join(data, latest, [id_col])

    def inside(n):
        return F.col(ts_col) >= F.col("_latest") - F.expr(f"INTERVAL '{int(n)}' DAY")

    if marks:
        return out.select(*df.columns, *[F.coalesce(inside(n), F.lit(False)).alias(f"in_{n}d") for n in marks])
    return out.filter(inside(days)).select(*df.columns)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], oldest: bool = False) -> DataFrame:
    """One whole row per key: the one that sorts last by ``order`` (or first).

    An aggregate of structs rather than a window: each map task keeps one row per key.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if oldest else F.max_by
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def top_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark limits each key inside the map tasks before the shuffle."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def nth_in_order(df: DataFrame, order: Sequence[str], k: int) -> list:
    """Values of the ``order`` columns at 0-based position ``k`` of the whole table, nulls last.

    One column is settled at a time, each pass reading only the rows tied so far. Its values are
    counted, dealt to ranges in order by ``repartitionByRange``, and the range that holds the
    position is found from the totals of the ranges; so any type that can be ordered will do,
    and no total sort is made in one task. The result is one row of scalars.
    """
    found: list = []
    rest = df
    for c in order:
        counts = rest.groupBy(F.struct(F.col(c).isNull().alias("last"), F.col(c).alias("v")).alias("o")).agg(F.count("*").alias("_n"))
        # written once: the ranges of a recomputed sample could differ
        ranged = checkpointed(counts.repartitionByRange("o").withColumn("_range", F.spark_partition_id()))
        totals = ranged.groupBy("_range").agg(F.sum("_n").alias("_t")).orderBy("_range").collect()  # one row per partition
        before = 0
        for r in totals:
            if before + r["_t"] > k:
                break
            before += r["_t"]
        inside = Window.partitionBy("_range").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
        run = ranged.filter(F.col("_range") == r["_range"]).withColumn("cum__n", F.sum("_n").over(inside) + F.lit(before))
        hit = run.filter(F.col("cum__n") > k).agg(F.min_by(F.struct(F.col("o.v").alias("v"), F.col("cum__n"), "_n"), "o").alias("h")).first()["h"]
        found.append(hit["v"])
        k -= hit["cum__n"] - hit["_n"]
        rest = rest.filter(F.col(c).eqNullSafe(literal(hit["v"], df, c)))
    return found


def literal(value, like: DataFrame, column: str) -> Column:
    """A Python value as a literal of a column's type (times go by text, free of zones)."""
    return F.lit(None if value is None else str(value)).cast(like.schema[column].dataType)


def content_hash(seed: int | str, *columns: str | Column) -> Column:
    """md5 of the seed and the columns as text, joined by ``|``: the same in any engine, so a twin can state the choice."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(c).cast("string") for c in columns]))


def hash_number(hashed: Column) -> Column:
    """The first 8 hexadecimal digits of a hash as a number below 2^32."""
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("bigint")


def hash_rank(df: DataFrame, keys: Sequence[str], id_cols: Sequence[str], seed: int, name: str) -> DataFrame:
    """1-based rank by a seeded hash of the id, per key: a repeatable random order.

    Ranks are counted inside ranges of the hash and shifted by the sizes of the ranges before,
    so one class may hold most rows.
    """
    data = df.withColumn("_h", content_hash(seed, *id_cols)).withColumn("_range", F.substring("_h", 1, 4))
    w = Window.partitionBy(*keys, "_range").orderBy("_h", *id_cols)
    local = data.withColumn(name, F.row_number().over(w))
    sizes = data.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    prior = _per_key(keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*keys, "_range", F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_before"))
    joined = _null_safe_join(local, before, [*keys, "_range"])
    return joined.withColumn(name, F.col(name) + F.col("_before")).select(*df.columns, name)


def order_index(df: DataFrame, value: str, id_cols: Sequence[str], name: str) -> DataFrame:
    """0-based position of each row by ``value`` (equal values in a repeatable random order)."""
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    run = running_totals(counts, [], value, ["_n"])
    starts = run.select(value, (F.col("cum__n") - F.col("_n")).alias("_start"))
    ranked = hash_rank(df, [value], id_cols, 0, "_within")
    joined = _null_safe_join(ranked, starts, [value])
    return joined.withColumn(name, F.col("_start") + F.col("_within") - 1).select(*df.columns, name)
