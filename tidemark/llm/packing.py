"""Sum-of-squares online packing of token sequences into fixed windows.

Each task packs the documents of its input split as they come. An array holds how many open
windows stand at each fill level; a document goes to the level (0: a new window) after which
the sum of squared counts is smallest. Documents longer than a window first fill whole windows.
When a task ends, what its open windows hold is cut and moved together, so that one window of
a task at most is left partly filled. Nothing is shuffled.
"""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import WHITE, Memo, map_batches
from tidemark.llm.token_counts import pre_token_finder, special_texts, tokenizer

WINDOW = 2048
ID_BYTES = 4
#: Words whose ids a worker remembers, twice.
REMEMBERED = 700_000
OUT_BYTES = 8 << 20

#: What a text without single spaces and line ends between words only has somewhere.
UNEVEN = ("  ", " \n", "\n ", "\n\n", *(c for c in WHITE if c not in " \n"))
#: Characters of texts whose words are looked up together.
TOGETHER = 4 << 20
_IDS: dict[tuple[str, int], Callable[[list[str]], Iterator[bytes]]] = {}


def encoder(path: str, remembered: int = REMEMBERED) -> Callable[[list[str]], Iterator[bytes]]:
    """A function from texts to their ids as little-endian unsigned 32-bit bytes, in turn; a worker remembers words.

    The words of texts with single spaces and line ends between words are numbered by Arrow, so
    each different one of some megabytes is looked up once; the ids are gathered by number.
    """
    if (path, remembered) in _IDS:
        return _IDS[path, remembered]
    own, find, specials = tokenizer(path), pre_token_finder(path), special_texts(path)

    def ids(text: str) -> bytes:
        return array("I", own.encode(text, add_special_tokens=False).ids).tobytes()

    # a word after a space, or after a line end (which is a token of its own there)
    def even_ids(words: list[str]) -> list[bytes]:
        spaced = [word if word[:1] == "\n" else " " + word for word in words]
        return [array("I", e.ids).tobytes() for e in own.encode_batch_fast(spaced, add_special_tokens=False)]

    general = Memo(ids, remembered)
    even = Memo(lambda word: even_ids([word])[0], remembered)
    line_end = len(ids("\n"))
    in_one_piece = any(" " in s or "\n" in s for s in specials)

    def is_even(text: str) -> bool:
        return not (in_one_piece or not text or text[0] in " \n" or text[-1] in " \n" or any(c in text for c in UNEVEN))

    def encode_even(texts: list[str]) -> list[bytes]:
        words = pc.split_pattern(pa.array([("\n" + text).replace("\n", " \n")[1:] for text in texts], pa.large_string()), " ")
        numbered = words.flatten().dictionary_encode()
        known = pa.array(even.all_of(numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), even_ids), pa.large_binary())
        gathered = known.take(numbered.indices)
        _, starts, data = gathered.buffers()
        cuts = np.frombuffer(starts, np.int64)[words.offsets.to_numpy()].tolist()
        # the first word of a text came with a line end of ours
        return [data[a + line_end : b].to_pybytes() for a, b in zip(cuts, cuts[1:])]

    def encode(texts: list[str]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to]) <= TOGETHER):
                chars += len(texts[to])
                to += 1
            part = texts[at:to]
            plain = [is_even(text) for text in part]
            evens = iter(encode_even(list(itertools.compress(part, plain)))) if any(plain) else iter(())
            for text, simple in zip(part, plain):
                yield next(evens) if simple else b"".join(map(general.__getitem__, find(text)))
            at = to

    _IDS[path, remembered] = encode
    return encode


class LevelPacker:
    """The level array and the open windows of one task. Pieces are (row key, start, ids, whole length)."""

    def __init__(self, window: int = WINDOW):
        self.window, self.counts = window, np.zeros(window + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]

    def level_for(self, size: int) -> int:
        """The level whose choice leaves the smallest sum of squares; among equals the fullest."""
        counts, last = self.counts, self.window - size
        gain = 2 * counts[size : size + last + 1]  # a window comes to level + size, unless that fills it
        gain = np.where(np.arange(size, self.window + 1) == self.window, -1, gain)
        cost = gain - 2 * counts[: last + 1] + 1
        cost[1:][counts[1 : last + 1] == 0] = np.iinfo(np.int64).max
        cost[0] = gain[0]  # a new window takes none away
        return last - int(np.argmin(cost[::-1]))

    def add(self, key, ids: bytes) -> Iterator[list[tuple]]:
        """Place a document; yields the windows that are full now."""
        total, step = len(ids) // ID_BYTES, self.window * ID_BYTES
        whole = total - total % self.window
        for start in range(0, whole, self.window):
            yield [(key, start, ids[start * ID_BYTES : start * ID_BYTES + step], total)]
        size = total - whole
        if not size:
            return
        level = self.level_for(size)
        pieces = self.open[level].pop() if level else []
        pieces.append((key, whole, ids[whole * ID_BYTES :], total))
        self.counts[level] -= bool(level)
        if level + size == self.window:
            yield pieces
        else:
            self.counts[level + size] += 1
            self.open[level + size].append(pieces)

    def close(self) -> Iterator[list[tuple]]:
        """Empty the open windows, fullest first, into windows that are cut full."""
        pieces, filled = [], 0
        for level in range(self.window, 0, -1):
            for held in self.open[level]:
                for key, start, ids, total in held:
                    while ids:
                        room = (self.window - filled) * ID_BYTES
                        part, ids = ids[:room], ids[room:]
                        pieces.append((key, start, part, total))
                        start, filled = start + len(part) // ID_BYTES, filled + len(part) // ID_BYTES
                        if filled == self.window:
                            yield pieces
                            pieces, filled = [], 0
            self.open[level] = []
        if pieces:
            yield pieces


def pack_documents(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 1, window: int = WINDOW, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: key, start, length, ids (binary), doc_tokens, sequence_id, offset.

    A document's tokens are those of its whole text (null: none) and ``end_id``, so every row
    has at least one piece, empty texts included. Each token is in one piece. ``ids`` are
    little-endian unsigned 32-bit. ``sequence_id`` tells the task in its upper bits. Rows that
    repeat are packed each; other columns are left out; an empty table gives no row. A worker
    remembers the ids of up to three times ``remembered`` words, about 150 bytes each.
    """
    end = np.array([end_id], "<u4").tobytes()
    kind = dict(documents.select(F.col(key)).dtypes)[key]
    docs = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, sequence = LevelPacker(window), TaskContext.get().partitionId() << 33
        encode, rows, held, key_type = encoder(path, remembered), [], 0, None

        def put(pieces: list[tuple]) -> None:
            nonlocal sequence, held
            offset = 0
            for name, start, ids, total in pieces:
                length = len(ids) // ID_BYTES
                rows.append((name, start, length, ids, total, sequence, offset))
                offset, held = offset + length, held + len(ids)
            sequence += 1

        def out() -> pa.RecordBatch:
            nonlocal held
            types = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["_key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            held = 0
            return batch

        for batch in batches:
            key_type = batch.column(0).type
            texts = [value or "" for value in batch.column(1).to_pylist()]
            for name, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                for pieces in packer.add(name, ids + end):
                    put(pieces)
                if held > OUT_BYTES:
                    yield out()
        for pieces in packer.close():
            put(pieces)
        if rows:
            yield out()

    packed = map_batches(docs, run, f"_key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("_key", key)
