"""SentencePiece encoding and decoding (operator 2).

An Aho-Corasick automaton over the pieces is followed through the text once. At each position its output links give
every piece that ends there, and each relaxes the best score of that position (Viterbi). Where no piece begins after
the blank mark of a word, the best path must break there, so words are solved alone and remembered.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import CLEARED, kept, kept_schema, parts

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words kept in each of two generations.
CACHED_WORDS = 250_000


class Automaton:
    """Aho-Corasick over words: `step[state]` are the state's own transitions, `fail[state]` is the state of its longest
    proper suffix, `ends[state]` the words that end there, longest first: its own and those along the output links."""

    def __init__(self, words: dict[str, tuple]) -> None:
        self.step: list[dict[str, int]] = [{}]
        self.ends: list[tuple] = [()]
        for word, entry in words.items():
            state = 0
            for char in word:
                following = self.step[state].get(char)
                if following is None:
                    following = self.step[state][char] = len(self.step)
                    self.step.append({})
                    self.ends.append(())
                state = following
            self.ends[state] = (entry,)
        self.fail = [0] * len(self.step)
        level = list(self.step[0].values())
        while level:
            deeper = []
            for state in level:
                for char, following in self.step[state].items():
                    back = self.fail[state]
                    while back and char not in self.step[back]:
                        back = self.fail[back]
                    self.fail[following] = self.step[back].get(char, 0)
                    self.ends[following] += self.ends[self.fail[following]]
                    deeper.append(following)
            level = deeper


class Encoder:
    """Pieces, scores and byte pieces of a SentencePiece model file; texts as ids with the highest summed score.

    A blank goes before the text and stands for every space. A character that no piece spells becomes its UTF-8 bytes'
    pieces (the unknown id if the model has none), at a score below that of any piece. Of equal scores the path whose
    last piece is longer wins, position by position. Other normalization is left to the caller.
    """

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.vocab_size()
        self.byte_ids: dict[int, int] = {}
        self.spelled = [b""] * size
        self.pieces: dict[str, tuple[int, int, float]] = {}
        self.single: set[str] = set()
        self.unknown = model.unk_id()
        lowest, inner = 0.0, False
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.spelled[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                score = model.get_score(i)
                lowest = min(lowest, score)
                self.spelled[i] = piece.replace(BLANK, " ").encode()
                self.pieces[piece] = (i, len(piece), score)
                inner |= BLANK in piece.lstrip(BLANK)
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton = Automaton(self.pieces)
        self.unknown_score = lowest - UNKNOWN_PENALTY
        self.word_start = None if inner else re.compile(f"(?<=[^{BLANK}])(?={BLANK})")
        self.scores = np.zeros(size)
        self.scores[[i for i, _, _ in self.pieces.values()]] = [s for _, _, s in self.pieces.values()]
        self.begins_unspelled = np.zeros(size, np.int64)  # byte pieces of a character's first byte, and the unknown id
        self.begins_unspelled[[i for b, i in self.byte_ids.items() if b & 0xC0 != 0x80] + [self.unknown] * (self.unknown >= 0)] = 1
        self.known: dict[str, bytes] = {}
        self.known_before: dict[str, bytes] = {}

    def fallback(self, char: str) -> list[int]:
        found = [self.byte_ids.get(b) for b in char.encode()]
        return [self.unknown] if None in found else found

    def solve(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        n = len(text)
        best, size, last = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)  # size, last: of the last piece
        best[0] = 0.0
        step, fail, ends = self.automaton.step, self.automaton.fail, self.automaton.ends
        spelled, state = self.single.issuperset(text), 0
        for end, char in enumerate(text, 1):
            while (following := step[state].get(char)) is None and state:
                state = fail[state]
            state = following or 0
            for piece, length, score in ends[state]:
                total = best[end - length] + score
                if total > best[end]:  # longer pieces come first, so an equal score changes nothing
                    best[end], size[end], last[end] = total, length, piece
            if not spelled and char not in self.single and best[end - 1] + self.unknown_score > best[end]:
                best[end], size[end], last[end] = best[end - 1] + self.unknown_score, 1, -1
        ids: list[int] = []
        at = n
        while at:
            if last[at] < 0:
                ids += reversed(self.fallback(text[at - 1]))
            else:
                ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return array("I", ids).tobytes()

    def remembered(self, word: str) -> bytes:
        """The ids of a word and the blank mark before it, kept while the word is in use: the older of two generations
        goes when the newer is full."""
        ids = self.known_before.get(word) or self.solve(BLANK + word)
        if len(word) <= 64:
            if len(self.known) >= CACHED_WORDS:
                self.known_before, self.known = self.known, {}
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> tuple[np.ndarray, float, int]:
        """Ids, summed score, how many characters no piece spells; an empty text has no ids."""
        if not text:
            return np.empty(0, np.uint32), 0.0, 0
        if self.word_start is None:
            words = [text.replace(" ", BLANK)]
        elif text[0] == " " or "  " in text or BLANK in text:  # a piece may hold several marks
            words = [w[1:] for w in self.word_start.split(BLANK + text.replace(" ", BLANK))]
        else:
            words = text.split(" ")
        found = list(map(self.known.get, words))
        if None in found:
            found = [one or self.remembered(word) for one, word in zip(found, words, strict=True)]
        ids = np.frombuffer(b"".join(found), np.uint32)
        unspelled = int(self.begins_unspelled[ids].sum())
        return ids, float(self.scores[ids].sum()) + unspelled * self.unknown_score, unspelled

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; ids of control or unknown pieces spell nothing."""
        return b"".join(map(self.spelled.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace") if len(ids) else ""


@lru_cache(maxsize=2)
def encoder(model_file: str) -> Encoder:
    """One for each model and Python worker, with the words that it has solved."""
    return Encoder(model_file)


CLEARED.append(encoder.cache_clear)


def encode_texts(docs: DataFrame, model_file: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, ids (array of int), score, n_unspelled: each whole text as pieces (null and empty: none).

    One row for each row of docs, repeated ones too; an empty table gives no rows. A kept column with the name of a
    result is called kept_<name>; texts of any length are encoded whole.
    """
    schema = kept_schema(docs, keep, "ids array<int>, score double, n_unspelled long")
    names = [*docs.select(*kept(keep, ["ids", "score", "n_unspelled"])).columns, "ids", "score", "n_unspelled"]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model_file)
        for batch in parts(batches):
            found = [coder.encode(x or "") for x in batch.column(batch.num_columns - 1).to_pylist()]
            sizes = np.cumsum([0, *[len(ids) for ids, _, _ in found]]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.uint32), *[ids for ids, _, _ in found]]).astype(np.int32)
            added = [pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat)), pa.array([s for _, s, _ in found], pa.float64()), pa.array([u for _, _, u in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=names)

    return docs.select(*keep, F.col(text).alias("encoded_text")).mapInArrow(of_batches, schema)


def decode_ids(encoded: DataFrame, model_file: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """The columns `keep`, decoded (text), n_pieces, ids_crc32 (little-endian 32-bit), decoded_sha256; null ids count
    as none.

    One row for each row of encoded, repeated ones too; an empty table gives no rows. A kept column with the name of a
    result is called kept_<name>.
    """
    results = ["decoded", "n_pieces", "ids_crc32", "decoded_sha256"]
    names = [*encoded.select(*kept(keep, results)).columns, *results]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model_file)
        for batch in parts(batches):
            column = batch.column(batch.num_columns - 1)
            rows = [column[i].values for i in range(len(column))]
            arrays = [x.to_numpy() if x is not None else np.empty(0, np.int32) for x in rows]
            texts = [coder.decode(x) for x in arrays]
            added = [
                pa.array(texts, pa.string()),
                pa.array([len(x) for x in arrays], pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in arrays], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=names)

    return encoded.select(*keep, F.col(ids).alias("read_ids")).mapInArrow(of_batches, kept_schema(encoded, keep, "decoded string, n_pieces long, ids_crc32 long, decoded_sha256 string"))
