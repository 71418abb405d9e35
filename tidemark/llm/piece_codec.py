"""SentencePiece BPE encoding by a table of last tokens, and decoding.

For a merge-type vocabulary each prefix of a text has one encoding, so it has one last token.
An automaton lists the vocabulary's matches that end at a place; a match is that last token if
it and the last token of the prefix before it encode, as a pair, to themselves. The table is
filled from left to right and the ids are read from it backwards.

Texts are cut before each run of spaces, which no piece crosses; the encoding of a cut-out
word is remembered by a worker.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import Memo, map_batches

SPACE = "▁"  # how the vocabulary writes a space
#: Words, and pairs of tokens, that a worker remembers, twice.
REMEMBERED = 300_000
PAIRS_REMEMBERED = 500_000
#: In the table of last tokens: a character that the vocabulary lacks, and the start of a word.
LONE, NOTHING = 1 << 20, 1 << 22
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

_LOADED: dict[str, PieceCodec] = {}


class PieceCodec:
    """Vocabulary of one model file. Scores order the merges, as in the library."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.control = {i for i in range(size) if model.is_control(i)}
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(size) if model.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        plain = [i for i in range(size) if not (model.is_byte(i) or i in self.control or model.is_unknown(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: model.get_score(i) for i in plain}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.pairs = Memo(self._pair, PAIRS_REMEMBERED)
        self.words = Memo(self.word_ids, REMEMBERED)
        # a word after a space, or after a line end, which is a piece of its own if no piece holds it
        self.even = Memo(lambda word: self.word_ids(word if word[:1] == "\n" else SPACE + word), REMEMBERED)
        self.line_ends_cut = not any("\n" in piece for piece in self.pieces)
        self.texts = [piece.replace(SPACE, " ") for piece in self.pieces]
        self.apart = np.zeros(size, bool)  # ids that are not simply their own text
        self.apart[[self.unknown, *self.control, *(i for i, b in self.byte_of.items() if b > 127)]] = True
        for i, b in self.byte_of.items():
            self.texts[i] = chr(b)
        edge = np.array([self.begin, self.end], "<u4").tobytes()
        self.begin_bytes, self.end_bytes = edge[:4], edge[4:]

    def merged(self, text: str) -> list[str]:
        """The merges carried out one by one, best score first and then leftmost: the test of a pair."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _pair(self, key: int) -> bool:
        """Whether two tokens, packed in one number, stand side by side in an encoding; without a left one, whether it encodes to itself."""
        left, right = key >> 21, self.pieces[key & 0x1FFFFF]
        if left == NOTHING:
            return self.merged(right) == [right]
        before = self.pieces[left] if left < LONE else chr(left - LONE)
        return self.merged(before + right) == [before, right]

    def tokens(self, word: str) -> list[int]:
        """The tokens of a word: ids, or ``LONE`` plus a character that the vocabulary lacks."""
        n, pairs, sizes = len(word), self.pairs, []
        last = [-1] * (n + 1)
        last[0] = NOTHING
        length = [1] * (n + 1)
        done = 0  # places up to here have their last token
        for end, (size, piece) in self.automaton.iter(word):
            end += 1
            if last[end] >= 0:
                continue
            while done < end - 1:  # a place that no match fits holds a lone character
                done += 1
                if last[done] < 0:
                    last[done] = LONE + ord(word[done - 1])
            if pairs[last[end - size] << 21 | piece]:
                last[end], length[end] = piece, size
        for place in range(done + 1, n + 1):
            if last[place] < 0:
                last[place] = LONE + ord(word[place - 1])
        at = n
        while at:
            sizes.append(last[at])
            at -= length[at]
        return sizes[::-1]

    def word_ids(self, word: str) -> bytes:
        ids = self.tokens(word)
        if max(ids) >= LONE:
            ids = [b for i in ids for b in ([i] if i < LONE else [self.byte_id.get(b, self.unknown) for b in chr(i - LONE).encode()])]
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit bytes."""
        if not text:
            return self.begin_bytes + self.end_bytes
        if self.line_ends_cut and text[0] != " " and text[-1] != " " and "  " not in text and " \n" not in text and SPACE not in text and text[0] != "\n":
            body = map(self.even.__getitem__, text.replace("\n", " \n").split(" "))
        else:
            body = map(self.words.__getitem__, WORD.findall(SPACE + text.replace(" ", SPACE)))
        return self.begin_bytes + b"".join(body) + self.end_bytes

    def decode(self, ids: bytes) -> str:
        """The text of ids: control ids are silent, bytes join to UTF-8, the space put in front goes."""
        numbers = np.frombuffer(ids, "<u4")
        if len(numbers) > 2 and numbers[0] == self.begin and numbers[-1] == self.end and not self.apart[numbers[1:-1]].any():
            return "".join(map(self.texts.__getitem__, numbers[1:-1].tolist())).removeprefix(" ")
        out, raw, first = [], bytearray(), True
        for i in numbers.tolist():
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
                first = False
            if i in self.control:
                continue
            piece = " ⁇ " if i == self.unknown else self.pieces[i]
            out.append(piece[1:] if first and piece[0] == SPACE else piece)
            first = False
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")


def codec(path: str) -> PieceCodec:
    """The codec of a model file, made once per worker."""
    if path not in _LOADED:
        _LOADED[path] = PieceCodec(path)
    return _LOADED[path]


def encode_documents(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every whole text, ids as little-endian unsigned 32-bit bytes with begin and end.

    Null texts count as empty: begin and end only. Rows that repeat each get their row; other
    columns are left out.
    """
    kind = dict(documents.select(F.col(key)).dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path).encode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(t or "") for t in batch.column(1).to_pylist()], pa.binary())], ["_key", "ids"])

    return map_batches(documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")), run, f"_key {kind}, ids binary").withColumnRenamed("_key", key)


def decode_documents(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, text) of encoded rows; null ids give an empty text."""
    kind = dict(encoded.select(F.col(key)).dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path).decode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(i or b"") for i in batch.column(1).to_pylist()], pa.string())], ["_key", "text"])

    return map_batches(encoded.select(F.col(key).alias("_key"), "ids"), run, f"_key {kind}, text string").withColumnRenamed("_key", key)


def round_trip(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encode, then decode, each text in one pass over the table."""
    kind = dict(documents.select(F.col(key)).dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                    pa.array([hashlib.sha256(own.decode(i).encode()).hexdigest() for i in ids]),
                ],
                ["_key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    docs = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return map_batches(docs, run, f"_key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("_key", key)
