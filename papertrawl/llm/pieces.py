"""SentencePiece encoding and decoding by the last token of every prefix.

The encoder merges neighbours by the score of the merged piece, the leftmost of equals first. Merges inside a prefix
never depend on what follows, so the encoding of every prefix of a word ends in one token, and a row of tokens is the
encoding of its text exactly if every two neighbours are what the merges make of their joint text. So an automaton
finds the pieces that end at each place, the one that goes with the last token of the prefix before it is stored, and
the ids are read backwards from the end. Whether two tokens go together is tested by running their own merges in
step and watching the two symbols at the border: they must never be the best merge.

A text is cut where no piece can reach across: before a run of space marks that follows other characters, around
white space and other characters that no piece contains. Characters without a piece become their UTF-8 bytes.

The model's path is a parameter; the file, of under 1 MB, is read on the driver and sent to the tasks once. Models other
than byte-pair ones with byte fallback, escaped spaces and unchanged characters are refused.

Defined results: null is the empty text, whose only id is the end id where one is asked for; a doc_id may be null; repeated
rows give repeated rows; an empty table gives an empty result; other columns are not read; a text and its ids must
each fit in a row.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrawl.session import ship_with_tasks

ship_with_tasks(__name__)

MARK = "▁"
#: Words up to this length are remembered, at most so many at a time.
MEMO_CHARS, MEMO_WORDS = 48, 400_000
# ---- fixed values of the model file: kinds of pieces and fields ----
NORMAL, CONTROL, BYTE = 1, 3, 6
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_MODEL_TYPE, _SUFFIX_MARK, _BYTE_FALLBACK, _END_PIECE, _BPE = 3, 24, 35, 47, 2
_CHARS_MAP, _DUMMY_PREFIX, _SQUEEZE, _ESCAPE = 2, 3, 4, 5


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of one message: numbers, raw bytes of length-delimited ones, floats of four bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        raw = data[at:at + size]
        at += size
        yield tag >> 3, struct.unpack("<f", raw)[0] if kind == 5 else raw


class Pieces:
    """Encoder and decoder of one model."""

    def __init__(self, model: bytes):
        self.pieces: list[bytes] = []
        kinds: list[int] = []
        self.score: dict[str, float] = {}
        trainer: dict = {}
        normalizer: dict = {}
        self.id: dict[str, int] = {}
        for field, value in _fields(model):
            if field == _PIECES:
                own = {1: b"", 2: 0.0, 3: NORMAL} | dict(_fields(value))
                if own[3] == NORMAL:
                    self.score[own[1].decode()] = own[2]
                    self.id[own[1].decode()] = len(kinds)
                self.pieces.append(own[1])
                kinds.append(own[3])
            elif field == _TRAINER:
                trainer = dict(_fields(value))
            elif field == _NORMALIZER:
                normalizer = dict(_fields(value))
        if (trainer.get(_MODEL_TYPE) != _BPE or not trainer.get(_BYTE_FALLBACK) or trainer.get(_SUFFIX_MARK)
                or normalizer.get(_CHARS_MAP) or normalizer.get(_SQUEEZE, 1) or not normalizer.get(_ESCAPE, 1)
                or not set(kinds) <= {NORMAL, 2, CONTROL, BYTE}):
            raise ValueError("only byte-pair models with byte fallback that leave characters as they are")
        self.prefix = MARK if normalizer.get(_DUMMY_PREFIX, 1) else ""
        self.byte_id = [0] * 256
        self.shown = []  # what each id adds to a decoded text
        for i, (piece, kind) in enumerate(zip(self.pieces, kinds, strict=True)):
            if kind == BYTE:
                self.byte_id[int(piece[1:-1], 16)] = i
            self.shown.append(bytes([int(piece[1:-1], 16)]) if kind == BYTE else b"" if kind == CONTROL
                              else " ⁇ ".encode() if kind == 2 else piece.replace(MARK.encode(), b" "))
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.is_control = [k == CONTROL for k in kinds]
        self.end = self.pieces.index(trainer.get(_END_PIECE, b"</s>"))

        # tokens: the pieces that merges can make, and single characters of theirs that are no pieces
        self.alphabet = set("".join(self.score))
        self.tokens = [*self.score, *sorted(self.alphabet - set(self.score))]
        self.automaton = ahocorasick.Automaton()
        for t, piece in enumerate(self.tokens):
            self.automaton.add_word(piece, t)
        self.automaton.make_automaton()
        self.length = [len(t) for t in self.tokens]
        self.out = [struct.pack("<i", self.id[t]) if t in self.id else self._bytes(t) for t in self.tokens]
        self.merges: list = [None] * len(self.tokens)
        self.fitting: dict[int, bool] = {}
        joins = any(MARK in t.lstrip(MARK) for t in self.tokens)  # a piece with a mark after other characters
        breaks = "".join(c for c in "\t\n\x0b\x0c\r" if c not in self.alphabet)
        other = f"[^{MARK}{breaks}]"
        self.words = re.compile(f"[^{breaks}]+|[{breaks}]+" if joins and breaks else "(?s:.+)" if joins else
                                f"{MARK}+{other}*|{other}+" + (f"|[{breaks}]+" if breaks else ""))
        self.foreign = re.compile("([^" + "".join(map(re.escape, sorted(self.alphabet))) + "]+)")
        self.memo: dict[str, bytes] = {}

    def _bytes(self, text: str) -> bytes:
        return b"".join(struct.pack("<i", self.byte_id[b]) for b in text.encode())

    def _merged(self, token: int) -> tuple[list, list, list]:
        """Scores of the merges that make a token of its characters, and its last and first symbol before and after each."""
        if self.merges[token] is None:
            symbols = list(self.tokens[token])
            scores, last, first = [], [symbols[-1]], [symbols[0]]
            while len(symbols) > 1:
                best, at = None, 0
                for i in range(len(symbols) - 1):
                    score = self.score.get(symbols[i] + symbols[i + 1])
                    if score is not None and (best is None or score > best):
                        best, at = score, i
                if best is None:
                    break
                symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
                scores.append(best)
                last.append(symbols[-1])
                first.append(symbols[0])
            self.merges[token] = scores, last, first
        return self.merges[token]

    def _whole(self, token: int) -> bool:
        """Whether merges make this token of its own characters."""
        return self._merged(token)[1][-1] == self.tokens[token]

    def _fit(self, left: int, right: int) -> bool:
        """Whether the merges make exactly these two tokens of their joint text."""
        if not self._whole(right):
            return False
        ours, last, _ = self._merged(left)
        theirs, _, first = self._merged(right)
        i = j = 0
        while True:
            a = ours[i] if i < len(ours) else None
            b = theirs[j] if j < len(theirs) else None
            across = self.score.get(last[i] + first[j])
            # the best score goes first, and of equal ones the leftmost: left token, border, right token
            if a is not None and (across is None or a >= across) and (b is None or a >= b):
                i += 1
            elif across is not None and (b is None or across >= b):
                return False
            elif b is not None:
                j += 1
            else:
                return True

    def _tokens(self, word: str) -> list[int]:
        """The tokens of a word of known characters."""
        # a token at the start of the word is tested against the empty prefix, which stands as one more token
        size, length, fitting = len(self.tokens), self.length, self.fitting
        ends, done = [size] + [-1] * len(word), -1
        for at, token in self.automaton.iter(word):
            if at == done:
                continue
            left = ends[at + 1 - length[token]]
            pair = left * size + token
            if pair in fitting:
                good = fitting[pair]
            else:
                good = fitting[pair] = self._whole(token) if left == size else self._fit(left, token)
            if good:
                ends[at + 1], done = token, at
        found, at = [], len(word)
        while at:
            found.append(ends[at])
            at -= length[ends[at]]
        return found[::-1]

    def _word(self, word: str) -> bytes:
        known = self.memo.get(word)
        if known is not None:
            return known
        if self.alphabet.issuperset(word):
            ids = b"".join([self.out[t] for t in self._tokens(word)])
        else:
            ids = b"".join([self._bytes(part) if k % 2 else b"".join([self.out[t] for t in self._tokens(part)])
                            for k, part in enumerate(self.foreign.split(word))])
        if len(word) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[word] = ids
        return ids

    def encode(self, text: str, end: bool = False) -> np.ndarray:
        shown = (self.prefix + text).replace(" ", MARK) if text else ""
        memo, word = self.memo.get, self._word
        ids = [memo(w) or word(w) for w in self.words.findall(shown)]
        if end:
            ids.append(struct.pack("<i", self.end))
        return np.frombuffer(b"".join(ids), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        """As encoded, without the mark in front; bytes that are no UTF-8 become U+FFFD one by one."""
        listed = ids.tolist()
        raw = b"".join([self.shown[i] for i in listed])
        first = next((i for i in listed if not self.is_control[i]), None)
        if self.prefix and first is not None and not self.is_byte[first] and raw[:1] == b" " and self.pieces[first].startswith(MARK.encode()):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            out = []
            while raw:
                try:
                    out.append(raw.decode())
                    break
                except UnicodeDecodeError as wrong:
                    out.append(raw[:wrong.start].decode() + "�")
                    raw = raw[wrong.start + 1:]
            return "".join(out)


def _sent(df: DataFrame, model: str | None):
    return df.sparkSession.sparkContext.broadcast(Path(model or default_model()).read_bytes())


def encode(docs: DataFrame, model: str | None = None, end: bool = True) -> DataFrame:
    """doc_id, ids (array of int) of every whole text."""
    sent = _sent(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(sent.value)
        for batch in batches:
            found = [pieces.encode(text.as_py() or "", end) for text in batch.column("text")]
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found])))
            values = np.concatenate(found) if found else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids and the text they stand for."""
    sent = _sent(encoded, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(sent.value)
        for batch in batches:
            lists = batch.column("ids")
            values = lists.flatten().to_numpy(zero_copy_only=False)
            stops = np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))
            texts = [pieces.decode(part) for part in np.split(values, stops[:-1])] if len(stops) else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(texts, pa.string())],
                                             ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, text string")
