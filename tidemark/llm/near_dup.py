"""Near duplicates by bottom-k sketches of one hash function.

A text's set holds the hashes of its 5-word shingles; its sketch is the k smallest of them.
Texts with equal word sequences are one representative from the start. Inverted lists of
retained values give candidates: two sets that are alike enough share so many retained values
that the rarest part of both sketches has one in common, so only that part is listed. Pairs
whose likeness, estimated on the sketch of their union, is too small are dropped, and the rest
are compared on their full sets.

Long lists are not expanded into pairs. Each representative is first compared with three
centres of each of its lists; lists whose members are linked by then are done. Only members
of different components are still compared with one another, through lists of their full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import map_batches
from tidemark.llm.components import connected_components
from tidemark.session import written

WORDS = 5
RETAINED = 64
PERCENT = 75
CENTRES = 3


def shared_share(retained: int) -> float:
    """Of the retained values of one set, another that is alike enough holds at least this share.

    Less has a chance below 1e-7 at the limit of likeness: 5.8 deviations of a binomial count.
    """
    return PERCENT / 100 - 5.8 * math.sqrt(PERCENT * (100 - PERCENT) / 1e4 / retained)


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_set(text: str | None, words: int = WORDS) -> tuple[bytes, np.ndarray]:
    """The word sequence and the sorted distinct 63-bit shingle hashes of a whole text.

    Words are runs of anything but space and the controls 9 to 13, A-Z lower-cased. With fewer
    words than a shingle has, the whole sequence is the one shingle; without words there is none.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return b"", np.zeros(0, np.int64)
    whole = b" ".join(parts)
    if len(parts) < words:
        return whole, np.array([xxhash.xxh3_64_intdigest(whole, 7) >> 1], np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = len(parts) - words + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(words):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD[i % len(_ODD)] + hashes[i : i + n]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xE7037ED1A0B428DB)
    mixed ^= mixed >> np.uint64(29)
    return whole, np.unique((mixed >> np.uint64(1)).astype(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def sketches(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, retained: int = RETAINED) -> DataFrame:
    """(doc_id, fp, n_shingles, sketch): ``fp`` tells the word sequence, null where there is no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes, kept = [], [], []
            for value in batch.column(1).to_pylist():
                whole, hashes = shingle_set(value, words)
                prints.append(xxhash.xxh3_128_digest(whole) if len(hashes) else None)
                sizes.append(len(hashes))
                kept.append(hashes[:retained])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), _lists(kept)], ["doc_id", "fp", "n_shingles", "sketch"])

    docs = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(docs, run, "doc_id long, fp binary, n_shingles long, sketch array<long>")


def full_sets(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """(rep, shingles) of (rep, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingle_set(v, words)[1] for v in batch.column(1).to_pylist()])], ["rep", "shingles"])

    return map_batches(documents, run, "rep long, shingles array<long>")


def inverted_lists(reps: DataFrame, share: float) -> DataFrame:
    """(value, rep, n, pos): the rarest part of each sketch, without values that one representative alone retains.

    ``share`` is the part of a sketch that an alike one must hold. ``pos`` is a value's place
    in the order from rare to common, values of one representative alone first.
    """
    every = reps.select("rep", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("value"))
    common = every.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = every.join(common, "value").groupBy("rep").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.array_sort(F.collect_list(F.struct("df", "value"))).alias("held"))
    alone = F.col("m") - F.size("held")
    room = F.col("m") - F.ceil(F.col("m") * share - 1e-9) + 1 - alone
    kept = shared.withColumn("room", room.cast("int")).where("room > 0").select("rep", "n", alone.alias("alone"), F.posexplode(F.slice("held", F.lit(1), F.col("room"))).alias("i", "h"))
    return kept.select(F.col("h.value").alias("value"), "rep", "n", (F.col("alone") + F.col("i")).alias("pos"))


def open_lists(lists: DataFrame, grouped: DataFrame) -> DataFrame:
    """The lists, with a component for each member, of those values whose members are not in one component yet."""
    placed = lists.join(grouped.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    several = placed.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("value")
    return placed.join(several, "value")


def _alike_in_size(a: str, b: str) -> F.Column:
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * PERCENT)


def confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among pairs (a, b): estimated on union sketches first, then compared on full sets."""
    sketch = reps.select("rep", "sketch")
    near = pairs.join(sketch.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a").join(sketch.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, RETAINED)
    near = near.withColumn("u", union).where(F.size(F.array_intersect(F.array_intersect("sa", "sb"), "u")) >= F.size("u") * shared_share(RETAINED)).select("a", "b")
    near = near.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return near.where(100 * both >= PERCENT * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept), one row per row of the table.

    Two documents are linked if 100 times the shingles that both have is at least 75 times
    those that either has. ``component_id`` is the smallest key that links lead to, ``kept``
    marks it. Null and wordless texts have no shingle and no link. Rows that share a key are
    one node; a row without a key is kept as it is, linked with nothing. Keys are integers;
    other columns are left out.
    """
    table = written(sketches(documents, key, text), "sketches")
    known = table.where(F.col("fp").isNotNull() & F.col("doc_id").isNotNull())
    reps = known.groupBy("fp").agg(F.min_by(F.struct("doc_id", F.col("n_shingles").alias("n"), "sketch"), "doc_id").alias("r"))
    reps = written(reps.select("fp", F.col("r.doc_id").alias("rep"), "r.n", "r.sketch"), "representatives")
    lists = written(inverted_lists(reps, shared_share(RETAINED)), "inverted-lists")
    wanted = lists.select("rep").distinct()
    texts = documents.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text")).join(wanted, "rep", "left_semi")
    sets = written(full_sets(texts), "full-sets")

    orders = [F.col("rep"), *(F.xxhash64("rep", F.lit(i)) for i in range(1, CENTRES))]
    centres = lists.groupBy("value").agg(F.count(F.lit(1)).alias("members"), *(F.min_by(F.struct("rep", "n"), order).alias(f"c{i}") for i, order in enumerate(orders)))
    centres = centres.where("members > 1").select("value", F.array_distinct(F.array(*(f"c{i}" for i in range(CENTRES)))).alias("cs"))
    stars = lists.join(centres, "value").select("rep", "n", F.explode(F.filter("cs", lambda c: c["rep"] != F.col("rep"))).alias("c"))
    stars = stars.where(_alike_in_size("n", "c.n")).select(F.least("rep", "c.rep").alias("a"), F.greatest("rep", "c.rep").alias("b")).distinct()
    links = written(confirmed(stars, reps, sets), "star-links")
    grouped = connected_components(links)

    # those in lists that are still open are listed again by the rarest part of their full sets
    waiting = open_lists(lists, grouped).select("rep").distinct()
    whole = sets.join(waiting, "rep", "left_semi").select("rep", F.size("shingles").cast("long").alias("n"), F.col("shingles").alias("sketch"))
    left = written(open_lists(written(inverted_lists(whole, PERCENT / 100), "full-lists"), grouped), "open-lists")
    x = left.select("value", F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("component").alias("cx"))
    y = left.select("value", F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("component").alias("cy"))
    # at the first value that both have, what follows in either set bounds what they can share
    enough = (100 + PERCENT) * F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) >= PERCENT * (F.col("nx") + F.col("ny"))
    rest = x.join(y, (x["value"] == y["value"]) & (F.col("cx") < F.col("cy")) & enough)
    rest = rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    links = links.unionAll(written(confirmed(rest, reps, sets), "other-links"))
    # rows that share a key but not their words are tied through the key
    tied = known.select("doc_id", "fp").join(reps.select("fp", "rep"), "fp").select("doc_id", "rep", "fp")
    grouped = connected_components(links.unionAll(tied.where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    out = table.select("doc_id", "n_shingles").join(grouped.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).withColumnRenamed("doc_id", key)
