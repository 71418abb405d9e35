"""SpotSigs document fingerprints.

A signature is an anchor, which is a very common word, with the content words that follow it:
boilerplate of lists and menus has few anchors, prose has many. A document's fingerprint is
the set of its signatures. Near duplicates are found by partitions of set length, between
which likeness is bounded, with an inverted list over each set's rarest signatures and a
Jaccard count that stops as soon as the threshold is out of reach.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import map_batches

#: Very common words of English, German, French and Spanish (fixed values, a parameter of the functions below).
ANCHORS = frozenset(
    "the of and to in a is that it for was on are as with his they at be this from have or by one had not but what all were "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de des et un une est que qui dans en du au pour pas sur plus par il elle ce se ne son avec "
    "el los las y que del se por con una su para es al lo como más o pero sus le ya".split()
)
WORD = re.compile(r"[^\W_]+")
CHAIN = 2
#: Words without an anchor after which content words start chains themselves.
GAP = 8
LENGTH_STEP = 1.15


def signatures(text: str | None, anchors: frozenset = ANCHORS, chain: int = CHAIN) -> frozenset[int]:
    """The signatures of a whole text, hashed to 64 bits.

    A content word with no anchor among the ``GAP`` words before it starts a chain too, so that
    text without common words has signatures as well; whether it does depends on these words
    alone, not on the rest of the text. Where no chain is whole, all words are one signature.
    Without words there is none.
    """
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return frozenset()
    content, starts, since = [], [], GAP
    for word in words:
        if word in anchors:
            starts.append((word, len(content)))
            since = 0
        else:
            if since >= GAP:
                starts.append(("", len(content)))
            since += 1
            content.append(word)
    last = len(content) - chain
    found = {(word, *content[at : at + chain]) for word, at in starts if at <= last} or {("", *words)}
    digest = xxhash.xxh3_64_intdigest
    return frozenset(digest(" ".join(s)) for s in found)


def spelled(fingerprint: frozenset[int]) -> str:
    """A fingerprint as text: its signatures in order, 16 hexadecimal digits each; empty without any."""
    return ",".join(f"{s:016x}" for s in sorted(fingerprint))


def likeness(a: frozenset[int], b: frozenset[int], floor: float = 0.0) -> float:
    """Jaccard likeness of two fingerprints, 0.0 if it is below ``floor``; two empty ones are equal, 1.0.

    Set lengths alone bound it, so that most pairs below a floor are not counted out.
    """
    if not a and not b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if len(a) < floor * len(b):
        return 0.0
    both = len(a & b)
    value = both / (len(a) + len(b) - both)
    return value if value >= floor else 0.0


def length_partition(size, step: float = LENGTH_STEP):
    """The partition of a set length: sets at least 1 / step alike lie in one partition or in neighbours."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.log(F.lit(step))).cast("int")


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, n_signatures) of every whole text; null and wordless texts have an empty fingerprint."""
    kind = dict(documents.select(F.col(key)).dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [signatures(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(spelled, sets), pa.string()), pa.array(map(len, sets), pa.int64())], ["_key", "fingerprint", "n_signatures"])

    docs = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return map_batches(docs, run, f"_key {kind}, fingerprint string, n_signatures long").withColumnRenamed("_key", key)


def near_pairs(prints: DataFrame, threshold: float = 0.75, key: str = "doc_id") -> DataFrame:
    """(a, b, likeness): pairs of classes of equal fingerprints that are at least ``threshold`` alike.

    ``a`` and ``b`` are the smallest keys of their classes, a < b; a class stands for all its
    members, so copies are not expanded. The keys of a pair meet in a length partition, under a
    signature that is among the rarest of both sets. Empty fingerprints pair with nothing.
    """
    classes = prints.where("fingerprint != ''").groupBy("fingerprint").agg(F.min(key).alias("rep"))
    sets = classes.select("rep", F.split("fingerprint", ",").alias("s")).withColumn("n", F.size("s"))
    step = 1.0 / threshold
    spread = sets.select("rep", "n", F.explode("s").alias("sig"))
    rare = spread.join(spread.groupBy("sig").agg(F.count(F.lit(1)).alias("df")), "sig").groupBy("rep").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("held"))
    # all but the last ceil(t n) - 1 signatures, rarest first: alike sets share one of these
    prefix = F.slice("held", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int"))
    listed = rare.select("rep", "n", F.explode(prefix).alias("h")).select("rep", "n", F.col("h.sig").alias("sig"), F.col("h.df").alias("df"), length_partition("n", step).alias("part")).where("df > 1")
    x = listed.select(F.col("rep").alias("a"), F.col("n").alias("na"), "sig", "part")
    y = listed.select(F.col("rep").alias("b"), F.col("n").alias("nb"), "sig", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
    pairs = x.join(y, ["sig", "part"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb"))).select("a", "b").distinct()
    pairs = pairs.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("likeness")).where(F.col("likeness") >= threshold)


def edited_text(text: str, following: str) -> str:
    """The text whose last half (rounded down, in code points) gives way to as many of the next text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text, and compare both and the next document's.

    The next document is the one with the next smaller key, after the smallest the largest;
    null keys count as smallest, and rows that share a key follow one another by length and
    checksum of their texts. Returns key, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next and n_signatures for every row; a null text
    counts as empty, and a table of one row follows itself. Other columns are left out.

    Key ranges, twice as many as shuffle partitions, are cut at keys of the table. A range also
    gets the rows of the key that the next range starts with, so each task has what follows its
    own rows, and texts are shuffled once.
    """
    spark = documents.sparkSession
    docs = documents.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**62))).alias("_k"), F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.agg(F.percentile_approx("_k", [i / ranges for i in range(1, ranges + 1)], 10 * ranges)).first()[0]
    if found is None:
        found = [0]
    # each cut is a key of the table and the largest of its range; the last is the largest of all
    cuts = sorted({float(k) for k in found})
    bounds = [float("-inf"), *(_after(c) for c in cuts[:-1]), float("inf")]
    docs = docs.withColumn("_d", F.col("_k").cast("double"))
    if len(cuts) > 1:
        docs = Bucketizer(splits=bounds, inputCol="_d", outputCol="_b").transform(docs).withColumn("_range", F.col("_b").cast("int"))
        # in falling order the largest key of a range comes after the range above it
        largest = F.get(F.array(*(F.lit(c) for c in cuts)), F.col("_range"))
        docs = docs.withColumn("_also", F.when(F.col("_d") == largest, F.pmod(F.col("_range") + 1, F.lit(len(cuts)))))
    else:
        docs = docs.withColumn("_range", F.lit(0)).withColumn("_also", F.when(F.col("_d") == F.lit(cuts[0]), F.lit(0)))
    own, guest = F.struct(F.col("_range").alias("range"), F.lit(0).alias("guest")), F.struct(F.col("_also").alias("range"), F.lit(1).alias("guest"))
    dealt = docs.withColumn("_p", F.explode(F.when(F.col("_also").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    dealt = dealt.select("_p.range", "_p.guest", "_k", "_key", F.char_length("_text").alias("_n"), F.crc32("_text").alias("_c"), "_text")
    ordered = dealt.repartitionById(len(cuts), "range").sortWithinPartitions("range", "guest", F.desc("_k"), F.desc("_n"), F.desc("_c"))
    kind = dict(documents.select(F.col(key)).dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, done = None, None, []  # the row that waits for the one after it

        def finish(row, following: str, following_set: frozenset) -> None:
            name, own_text, own_set = row
            edited = edited_text(own_text, following)
            edited_set = signatures(edited)
            done.append((
                name, len(own_text), hashlib.sha256(edited.encode()).hexdigest(), spelled(own_set), spelled(edited_set), likeness(own_set, edited_set),
                likeness(own_set, following_set), len(own_set),
            ))

        def out(key_type) -> pa.RecordBatch:
            types = [key_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], OUT)
            done.clear()
            return batch

        for batch in batches:
            at, guests, names, texts = (batch.column(i).to_pylist() for i in (0, 1, 3, 6))
            for range_, is_guest, name, value in zip(at, guests, names, texts, strict=True):
                if range_ != last:
                    held, last = None, range_
                if is_guest and held is None:
                    continue
                found = signatures(value)
                if held is not None:
                    finish(held, value, found)
                held = None if is_guest else (name, value, found)
            if done:
                yield out(batch.column(3).type)

    schema = f"_key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long"
    return map_batches(ordered, run, schema).withColumnRenamed("_key", key)


OUT = ["_key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures"]


def _after(value: float) -> float:
    """The next larger double: a bucket of Spark holds its lower bound, a range here its upper one."""
    import math

    return math.nextafter(value, math.inf)
