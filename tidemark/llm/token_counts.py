"""Token counts without token ids.

A pre-token here is a word with the white space before it: no token of a byte-level BPE
crosses these cuts, so a document's count is the sum of its pre-tokens' counts. Each distinct
pre-token of the corpus is counted by the tokenizer once. Documents carry frequencies of
pre-tokens and are joined to these counts. The most frequent pre-tokens, a fixed number, go to
every task instead of through the shuffle: they are most of the volume and all of the skew. Long
pre-tokens are known by a digest there, so a frequent one may be among them, and none travels
whole with a document.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import SPACED_WORD, map_batches
from tidemark.session import written

#: Pre-tokens whose counts every task gets; a fixed bound on what is broadcast.
HEAD_ROWS = 400_000
#: Longer pre-tokens are known by a digest, which bounds the bytes of what is broadcast.
KEY_CHARS = 64
#: Distinct pre-tokens that a task gathers before it passes them on.
GATHERED = 300_000

_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker, single-threaded."""
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _LOADED[path] = loaded
    return _LOADED[path]


def special_texts(path: str) -> list[str]:
    """Texts of added tokens: they cut a text before pre-tokens are found."""
    return sorted((t.content for t in tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)


def pre_token_finder(path: str):
    """A function from a text to its pre-tokens; an added token that holds white space stays in one piece."""
    spaced = [s for s in special_texts(path) if re.search(r"\s", s)]
    if not spaced:
        return SPACED_WORD.findall
    cut = re.compile("(" + "|".join(map(re.escape, spaced)) + ")")
    return lambda text: [p for part in cut.split(text) if part for p in ([part] if part in spaced else SPACED_WORD.findall(part))]


def key_of(pre_token: str) -> str:
    """What stands for a pre-token in joins: itself, or, if it is long, its SHA-256 and a mark, which is longer than any short one."""
    return pre_token if len(pre_token) <= KEY_CHARS else hashlib.sha256(pre_token.encode()).hexdigest() + ":"


def key_column(pre_token: str) -> Column:
    """``key_of`` as a column."""
    return F.when(F.char_length(pre_token) <= KEY_CHARS, F.col(pre_token)).otherwise(F.concat(F.sha2(pre_token, 256), F.lit(":")))


def _frequencies(text: str, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = pre_token_finder(path), Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["pre_token", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for value in batch.column(0).to_pylist():
                if value:
                    seen.update(find(value))
                if len(seen) > GATHERED:
                    yield out()
        if seen:
            yield out()

    return run


def _token_numbers(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = tokenizer(path).encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(e) for e in found], pa.int64())], ["pre_token", "n", "tokens"])

    return run


def pre_token_counts(documents: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(pre_token, n, tokens): each distinct pre-token of the corpus, its frequency, and its token count, found once."""
    seen = map_batches(documents.select(F.col(text)), _frequencies(text, path), "pre_token string, n long")
    total = seen.groupBy("pre_token").agg(F.sum("n").alias("n"))
    return written(map_batches(total, _token_numbers(path), "pre_token string, n long, tokens long"), "pre-token-counts")


def count_tokens(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", head_rows: int = HEAD_ROWS) -> DataFrame:
    """(key, n_bytes, n_tokens) for every row, as the tokenizer's library counts the whole text.

    Null texts count as empty, with no token. Rows that repeat, in id or in text, each get their
    row; other columns are left out. ``path`` is the vocabulary file, readable on every executor.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    counts = pre_token_counts(docs, path, "_text").select(key_column("pre_token").alias("key"), "n", "tokens")
    head = {r["key"]: r["tokens"] for r in counts.orderBy(F.desc("n"), "key").limit(head_rows).select("key", "tokens").toLocalIterator()}
    shared = spark.sparkContext.broadcast(head)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, find, row = shared.value, pre_token_finder(path), TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sums, rest, rows, sizes = [], [], [], []
            for value in texts:
                total, tail = 0, []
                for pre_token, n in Counter(find(value)).items():
                    name = key_of(pre_token)
                    tokens = known.get(name)
                    if tokens is None:
                        tail.append((name, n))
                    else:
                        total += tokens * n
                sums.append(total)
                rest.append([{"p": p, "n": n} for p, n in tail])
                rows.append(row)
                sizes.append(len(value.encode()))
                row += 1
            kind = pa.list_(pa.struct([("p", pa.string()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(rows, pa.int64()), pa.array(sums, pa.int64()), pa.array(rest, kind)], ["_key", "n_bytes", "_row", "_sum", "_rest"]
            )

    kind = dict(docs.dtypes)["_key"]
    rows = written(map_batches(docs, split, f"_key {kind}, n_bytes long, _row long, _sum long, _rest array<struct<p: string, n: long>>"), "document-pre-tokens")
    tail = rows.select("_row", F.explode("_rest").alias("r")).select("_row", F.col("r.p").alias("key"), F.col("r.n").alias("f"))
    tail = tail.join(counts.select("key", "tokens"), "key").groupBy("_row").agg(F.sum(F.col("f") * F.col("tokens")).alias("_tail"))
    both = rows.select("_key", "n_bytes", "_row", "_sum").join(tail, "_row", "left")
    return both.select(F.col("_key").alias(key), "n_bytes", (F.col("_sum") + F.coalesce(F.col("_tail"), F.lit(0))).alias("n_tokens"))
