"""Mixing sources to target weights by a low-discrepancy schedule.

The words of each source, its documents in a shuffled order, are cut into blocks of equal
length. Slots of the mix are numbered 0, 1, 2, ... and the bits of a slot's number, read
backwards (van der Corput's sequence in base 2), are its ticket. The tickets are cut among the
sources in proportion to the blocks that each is to give, so that any run of slots holds the
sources near their shares. A source's slots are ranked and take its blocks in that order, from
the first block again when all are used.

Everything is a DataFrame expression. Running sums and ranks are made inside parts of bounded
size, and the totals of the parts before are added, so that a source may hold most rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import text_or_empty
from tidemark.session import written

#: What separates words, as in the contract of the other word operators.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: The mix holds SHARE / 2 times all words, a source at most CAP times its own.
HALVES, CAP = 3, 2
BLOCK_WORDS = 1024
#: Hexadecimal digits of the shuffling hash that number the parts of a source.
PART_DIGITS = 4
#: Slots whose ranks are counted in one piece.
SPAN = 1 << 16
#: Tickets whose owner is sought in one list, of at most so many sources.
RUN = 1 << 10
SEED = "13"


def sized(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, h): words of each text, and the hash that shuffles a source."""
    t = F.col(text)
    h = F.md5(F.concat_ws("/", F.lit(SEED), F.col(key).cast("string"), t))
    return documents.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.regexp_count(text_or_empty(t), F.lit(WORD)).cast("long").alias("size"), h.alias("h"))


def _before(*order: Column) -> Window:
    return Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, halves: int = HALVES, cap: int = CAP) -> DataFrame:
    """(place, source, source_size, target): one row per source, in the order of code points, null last.

    The sources share ``halves`` / 2 times all words by weight. A share above ``cap`` times the
    source's words stops there; what it leaves is shared again. Sources that stop are those whose
    words per weight are fewest, so one pass in that order finds them: the rest of the words over
    the rest of the weights is what a unit of weight gets. Whole numbers, divided once.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))  # one row per source from here on
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    rows = total.withColumn("place", place).withColumn("w", weight)
    common = math.lcm(*weights)
    order = (F.col("source_size") * (F.lit(common) / F.col("w")).cast("long"), F.col("place"))
    everything = Window.partitionBy(F.lit(0))
    rows = rows.withColumns({
        "shared": F.lit(halves) * F.sum("source_size").over(everything), "used": 2 * cap * F.coalesce(F.sum("source_size").over(_before(*order)), F.lit(0)),
        "weights": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(_before(*order)), F.lit(0)),
    })
    rows = rows.withColumn("stops", (F.col("shared") - F.col("used")) * F.col("w") >= 2 * cap * F.col("source_size") * F.col("weights"))
    rows = rows.withColumns({
        "left": F.col("shared") - F.coalesce(F.sum(F.when(F.col("stops"), 2 * cap * F.col("source_size"))).over(everything), F.lit(0)),
        "open": F.coalesce(F.sum(F.when(~F.col("stops"), F.col("w"))).over(everything), F.lit(0)),
    })
    target = F.when(F.col("stops"), cap * F.col("source_size").cast("double")).otherwise((F.col("left") * F.col("w")).cast("double") / F.nullif(2 * F.col("open"), F.lit(0)).cast("double"))
    return rows.select("place", "source", "source_size", target.alias("target"))


def slot_plan(targets: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Targets with ``quota`` words, ``blocks`` of the source, ``slots`` to use and ``first``, the source's first ticket."""
    quota, length = F.floor("target"), F.col("source_size")
    plan = targets.withColumns({"quota": quota, "blocks": F.ceil(length / block)})
    rest = F.ceil(F.pmod("quota", F.greatest(length, F.lit(1))) / block)
    whole = F.when(length > 0, F.floor(F.col("quota") / length)).otherwise(F.lit(0))
    plan = plan.withColumn("slots", F.when(length > 0, whole * F.col("blocks") + rest).otherwise(F.lit(0)))
    return plan.withColumn("first", F.coalesce(F.sum("slots").over(_before(F.col("place"))), F.lit(0)))


def schedule(plan: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(slot, place, block, words): what each slot of the mix takes, slots without a ticket left out.

    Of the first power of two of slots, those whose ticket is below the number of slots to use
    have one each, so every source gets exactly its slots.
    """
    spark = plan.sparkSession
    slots = plan.agg(F.sum("slots")).first()[0] or 0
    bits = max(1, (slots - 1).bit_length())
    ticket = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("long")
    points = spark.range(1 << bits).select(F.col("id").alias("slot"), ticket.alias("ticket")).where(F.col("ticket") < slots)
    owners = plan.where("slots > 0").select("place", "source_size", "quota", "blocks", "first", "slots")
    # the sources whose tickets lie in a run of tickets, as one short sorted list per run
    run = F.explode(F.sequence(F.floor(F.col("first") / RUN), F.floor((F.col("first") + F.col("slots") - 1) / RUN)))
    starts = owners.select("first", "place", run.alias("run")).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("first", "place"))).alias("starts"))
    dealt = points.withColumn("run", F.floor(F.col("ticket") / RUN)).join(starts, "run")
    owner = F.element_at(F.filter("starts", lambda s: s["first"] <= F.col("ticket")), -1)["place"]
    dealt = dealt.select("slot", owner.alias("place"), F.floor(F.col("slot") / SPAN).alias("span"))
    inside = Window.partitionBy("place", "span").orderBy("slot")
    counts = dealt.groupBy("place", "span").agg(F.count(F.lit(1)).alias("n"))
    prior = Window.partitionBy("place").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("place", "span", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("before"))
    ranked = dealt.withColumn("r", F.row_number().over(inside) - 1).join(counts, ["place", "span"]).join(owners.drop("first", "slots"), "place")
    turn, number = F.floor((F.col("r") + F.col("before")) / F.col("blocks")), F.pmod(F.col("r") + F.col("before"), F.col("blocks"))
    taken_before = turn * F.col("source_size") + number * block
    words = F.least(F.lit(block), F.col("source_size") - number * block, F.col("quota") - taken_before)
    return ranked.select("slot", "place", number.alias("block"), words.alias("words"))


def streamed(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Sizes with ``place`` and ``start``, the words of the source before the document, in the order of ``h``."""
    known = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).select("doc_id", "size", "h", "place", "source_size", "target")
    known = known.withColumn("part", F.substring("h", 1, PART_DIGITS))
    totals = known.groupBy("place", "part").agg(F.sum("size").alias("n"))
    prior = Window.partitionBy("place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("place", "part", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("before"))
    inside = Window.partitionBy("place", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = known.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(totals, ["place", "part"])
    return placed.withColumn("start", F.col("inside") + F.col("before")).drop("part", "inside", "before", "h")


def mixed(documents: DataFrame, weights: Sequence[int] = WEIGHTS, halves: int = HALVES, cap: int = CAP, block: int = BLOCK_WORDS, key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(pieces, documents): the mix, and every row with its place in it.

    ``pieces`` has (slot, doc_id, place, start, size, begin, length): slot by slot, which words of which
    documents the mix takes, from word ``begin`` of the document on. ``documents`` has (doc_id, size,
    place, source_size, target, start), one row per row of the table. Null texts have 0 words and no
    piece; a null source is a source; rows that share an id, null included, are documents of
    their own, and if their texts are equal too, which of them is taken is open. Other columns
    are left out.
    """
    sizes = written(sized(documents, key, text, source), "mix-sizes")
    plan = written(slot_plan(source_targets(sizes, weights, halves, cap), block), "mix-plan")
    slots = written(schedule(plan, block), "mix-slots")
    table = written(streamed(sizes, plan), "mix-streams")
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    cut = table.where("size > 0").select("doc_id", "place", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), last)).alias("block"))
    joined = cut.join(slots, ["place", "block"])
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("words"))
    pieces = joined.select("slot", "doc_id", "place", "start", "size", (low - F.col("start")).alias("begin"), (high - low).alias("length")).where("length > 0")
    return pieces, table


def mix_counts(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per row: how many words the mix takes, repeats counted."""
    pieces, table = mixed(documents, **options)
    # a document with words is known by its source and its start there
    taken = pieces.groupBy("place", "start", "size").agg(F.sum("length").alias("taken"))
    full = table.where("size > 0").join(taken, ["place", "start", "size"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    return full.unionByName(table.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))
