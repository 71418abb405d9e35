"""Feature families of several modalities in few passes.

Lone feature functions each aggregate their rows, and each exact median or entropy is a pass of
its own. Here every modality gives its plain aggregates in one pass, and the values that need
counting first (levels of a category, values whose median is asked) of all modalities are
counted together, dealt to ranges once, and read off there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.common import xlogx
from tidemark.operators.ordered import in_ranges, ranged_quantiles


@dataclass
class Modality:
    """What the features of one modality are made of.

    ``aggs`` are aliased aggregates of ``rows``, ``medians`` values whose exact median is taken,
    ``levels`` categories that are counted per level. ``out`` makes the features, by name, from a
    function that gives the column of a name; a name of ``levels`` is a struct of ``n`` (rows with
    a level), ``k`` (levels), ``nlogn`` (sum of n·ln n), ``mode`` (commonest, first of equals, as
    text), ``sd`` and ``mean`` (of the rows per level), null where no row has a level.
    """

    rows: DataFrame
    aggs: list[Column]
    out: Callable[[Callable[[str], Column]], dict[str, Column]]
    medians: dict[str, Column] = field(default_factory=dict)
    levels: dict[str, Column] = field(default_factory=dict)


def numbered(modalities: Sequence[Modality]) -> dict[tuple[int, str], int]:
    """A number for each counted name of each modality."""
    return {key: n for n, key in enumerate((i, name) for i, m in enumerate(modalities) for name in (*m.levels, *m.medians))}


def counted(modalities: Sequence[Modality], id_column: str) -> DataFrame | None:
    """``(id, _dim, _level, _v, _n)``: rows per level or value of every modality; None if nothing is counted."""
    parts, numbers = [], numbered(modalities)
    for i, m in enumerate(modalities):
        cells = [(name, e.cast("string"), F.lit(None).cast("double")) for name, e in m.levels.items()]
        cells += [(name, F.lit(None).cast("string"), e.cast("double")) for name, e in m.medians.items()]
        if cells:
            long = F.array(*[F.struct(F.lit(numbers[i, name]).alias("_dim"), level.alias("_level"), value.alias("_v")) for name, level, value in cells])
            parts.append(m.rows.select(id_column, F.inline(long)).filter("_level IS NOT NULL OR _v IS NOT NULL"))
    if not parts:
        return None
    return reduce(DataFrame.unionByName, parts).groupBy(id_column, "_dim", "_level", "_v").agg(F.count("*").alias("_n"))


def gather(parts: Sequence[Modality | DataFrame], id_column: str) -> DataFrame:
    """One row per id with the features of all parts, in their order; a part may be a table of one row per id.

    An id without rows in a part has nulls there; a name that an earlier part has too gets the
    suffix of its part number. Modalities must have left out rows without an id. An id of any
    size is aggregated in parts; the last step gets one row per id, part and counted name.
    """
    modalities = [p for p in parts if isinstance(p, Modality)]
    tables = [p.rows.groupBy(id_column).agg(*p.aggs) if isinstance(p, Modality) else p for p in parts]
    names = [[c for c in t.columns if c != id_column] for t in tables]
    stacked = [t.select(id_column, F.struct(*own).alias(f"_part{i}")) for i, (t, own) in enumerate(zip(tables, names, strict=True))]
    whole = [F.first(f"_part{i}", ignorenulls=True).alias(f"_part{i}") for i in range(len(parts))]
    counts = counted(modalities, id_column)
    if counts is not None:
        if any(m.medians for m in modalities):
            counts = in_ranges(counts, [id_column, "_dim", "_v", "_level"])
            stacked.append(ranged_quantiles(counts.filter("_v IS NOT NULL").drop("_level"), [id_column, "_dim"], [0.5]))
        n = F.col("_n")
        shape = F.struct(
            F.sum(n).alias("n"), F.count("*").alias("k"), F.sum(xlogx(n)).alias("nlogn"), F.min_by("_level", F.struct(-n, F.col("_level"))).alias("mode"),
            F.stddev_samp(n).alias("sd"), F.avg(n).alias("mean"),
        )
        stacked.append(counts.filter("_level IS NOT NULL").groupBy(id_column, "_dim").agg(shape.alias("_shape")))
        for i, m in enumerate(modalities):
            here = {name: F.col("_dim") == numbered(modalities)[i, name] for name in (*m.levels, *m.medians)}
            whole += [F.first(F.when(here[name], F.col("_shape")), ignorenulls=True).alias(f"_{i}_{name}") for name in m.levels]
            whole += [F.max(F.when(here[name], F.element_at("q", 1))).alias(f"_{i}_{name}") for name in m.medians]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked).groupBy(id_column).agg(*whole)
    columns, seen, modality = [F.col(id_column)], {id_column}, 0
    for i, (p, own) in enumerate(zip(parts, names, strict=True)):
        made = {c: F.col(f"_part{i}")[c] for c in own}
        if isinstance(p, Modality):
            counted_names = {name: F.col(f"_{modality}_{name}") for name in (*p.levels, *p.medians)}
            made, modality = p.out((made | counted_names).__getitem__), modality + 1
        made = {f"{c}_{i}" if c in seen else c: e for c, e in made.items()}
        seen.update(made)
        columns += [F.when(F.col(f"_part{i}").isNotNull(), e).alias(c) for c, e in made.items()]
    return merged.select(*columns)
