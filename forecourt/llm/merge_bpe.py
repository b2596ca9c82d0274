"""Exact merge-type (BPE) encoding by backtracking, for SentencePiece vocabularies.

An encoding by merges is the only sequence of pieces in which every two neighbours, taken alone
and merged again from characters, come out as those same two. It is found without a merge queue:
an Aho-Corasick automaton gives the pieces that begin at each position; the longest one is tried
that is compatible with the piece before, then shorter ones, and if none is left the position is
marked in a bitfield as failed and the piece before is taken back. A position is never tried
twice, so the work is linear in the text.

No piece holds a word mark after another character, so no merge crosses from one word into the
mark before the next: a text is cut there, and a word met before is looked up.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.llm.common import as_text

MARK = "▁"
#: Words kept for look-up until the table is laid aside for a new one, and pairs of pieces; under 200 MB.
CACHE = 300_000


class MergeEncoder:
    """Ids of a SentencePiece BPE model with identity normalisation, leading space and byte fallback."""

    def __init__(self, path: str, cache: int = CACHE):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model, self.cache, size = model, cache, model.vocab_size()
        if model.normalize(" a  b ") != MARK + MARK + "a" + MARK * 2 + "b" + MARK:
            raise ValueError("the model changes white space; only identity normalisation is supported")
        self.unknown, self.none = model.unk_id(), size
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.piece = [model.id_to_piece(i) for i in range(size)]
        self.length = [len(p) for p in self.piece]
        usable = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.id_of = {self.piece[i]: i for i in usable}
        self.score = {self.piece[i]: model.get_score(i) for i in usable}
        self.characters = {p for p in self.id_of if len(p) == 1}
        # the next shorter piece that a piece begins with
        self.shorter = [-1] * size
        for piece, i in self.id_of.items():
            self.shorter[i] = next((self.id_of[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.id_of), -1)
        self.cut_at_marks = not any(MARK in p.lstrip(MARK) for p in self.id_of)
        # the automaton reads a word from its end, so that what it reports at a place are the pieces that begin there
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            self.automaton.add_word(piece[::-1], i)
        self.automaton.make_automaton()
        self.histories: dict[int, list[tuple[float, str, str]] | None] = {}
        self.compatible: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def history(self, i: int) -> list[tuple[float, str, str]] | None:
        """How piece ``i`` is merged from its characters: score of each merge, first and last part before it.

        The last entry is the finished piece, which waits for ever. None if merging ends elsewhere.
        """
        if i not in self.histories:
            parts, steps = list(self.piece[i]), []
            while True:
                pairs = [(self.score[two], -k) for k in range(len(parts) - 1) if (two := parts[k] + parts[k + 1]) in self.score]
                if not pairs:
                    break
                score, k = max(pairs)
                steps.append((score, parts[0], parts[-1]))
                parts[-k:2 - k] = [parts[-k] + parts[1 - k]]
            self.histories[i] = [*steps, (-math.inf, parts[0], parts[-1])] if len(parts) == 1 else None
        return self.histories[i]

    def fits(self, before: int, piece: int) -> bool:
        """Whether two neighbours, merged again side by side, stay as they are: no pair across the border comes first.

        Of equal scores the leftmost pair is merged first.
        """
        if len(self.compatible) > 2 * self.cache:
            self.compatible.clear()
        self.compatible[before << 32 | piece] = found = self._fits(before, piece)
        return found

    def _fits(self, before: int, piece: int) -> bool:
        right = self.history(piece)
        if right is None or before == self.none:
            return right is not None
        left, i, j = self.history(before), 0, 0
        while True:
            across = self.score.get(left[i][2] + right[j][1])
            if across is not None and across > left[i][0] and across >= right[j][0]:
                return False
            if left[i][0] == right[j][0] == -math.inf:
                return True
            if left[i][0] >= right[j][0]:
                i += 1
            else:
                j += 1

    def pieces(self, text: str) -> list[int]:
        """The encoding of a run of characters that are all pieces."""
        n, length, shorter, compatible = len(text), self.length, self.shorter, self.compatible
        longest, last = [0] * n, -1
        for end, i in self.automaton.iter(text[::-1]):  # of those that begin at a place, the longest first
            if end != last:
                longest[n - 1 - end], last = i, end
        out: list[int] = []
        at, failed, before, piece = 0, 0, self.none, longest[0]
        while True:
            while piece >= 0:
                fits = compatible.get(before << 32 | piece)
                if fits is None:
                    fits = self.fits(before, piece)
                if fits and not (failed and failed >> at + length[piece] & 1):
                    break
                piece = shorter[piece]
            else:
                failed |= 1 << at
                piece = out.pop()
                at -= length[piece]
                piece, before = shorter[piece], out[-1] if out else self.none
                continue
            out.append(piece)
            at += length[piece]
            if at == n:
                return out
            before, piece = piece, longest[at]

    def encode_word(self, word: str) -> list[int]:
        if self.characters.issuperset(word):
            return self.pieces(word)
        ids: list[int] = []
        start = 0
        for i, c in enumerate(word):
            if c not in self.characters:
                if i > start:
                    ids += self.pieces(word[start:i])
                ids += [self.bytes[b] for b in c.encode("utf-8")] if self.bytes else [self.unknown]
                start = i + 1
        return ids + self.pieces(word[start:]) if start < len(word) else ids

    def _word(self, word: str) -> bytes:
        """Looks a word up among those met before the last clearing, or encodes it."""
        found = self.older.get(word)
        if found is None:
            found = array("I", self.encode_word(word)).tobytes()
        if len(word) <= 64:
            if len(self.words) >= self.cache:
                self.older, self.words = self.words, {}
            self.words[word] = found
        return found

    def words_of(self, text: str) -> list[str]:
        """Runs that no merge leaves: marks with the characters after them, and line ends if they are no piece."""
        if not text:
            return []
        text = " " + text
        if not self.cut_at_marks:
            return [text.replace(" ", MARK)]
        out: list[str] = []
        for n, line in enumerate([text] if "\n" in self.id_of else text.split("\n")):
            if n:
                out.append("\n")
            if "  " in line or MARK in line or line.endswith(" "):
                out += re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", line.replace(" ", MARK))
            else:
                first, *rest = line.split(" ")
                if first:
                    out.append(first)
                out += [MARK + w for w in rest]
        return out

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text as unsigned 32-bit integers."""
        packed, new = [], self._word
        for word in self.words_of(text):
            packed.append(self.words.get(word) or new(word))
        return np.frombuffer(b"".join(packed), np.uint32)


_ENCODERS: dict[str, MergeEncoder] = {}


def encoder(path: str) -> MergeEncoder:
    """One encoder per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = MergeEncoder(path)
    return _ENCODERS[path]


def encode_texts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``row`` (all input columns) with ``ids``, an array of ints for the whole text; null and empty texts have none."""

    @F.pandas_udf("array<int>")
    def ids_of(texts: pd.Series) -> pd.Series:
        own = encoder(path)
        return pd.Series([own.encode(t) for t in texts])

    seen = docs.select(F.struct("*").alias("row"))
    return seen.withColumn("ids", ids_of(as_text(F.col("row").getField(text))))


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids``."""

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        model = encoder(path).model
        return pd.Series([model.decode(x.tolist()) for x in ids])

    return encoded.withColumn("decoded", text_of("ids"))


def round_trips(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of each row: ids are made, digested and decoded in one pass.

    The digest of ids is that of their decimal digits joined by commas. Null reads as empty (no
    ids, empty decoded text). Rows are independent: repeated rows, ties and empty tables are fine.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        digits = [str(i) for i in range(own.none)]
        for batch in batches:
            n_tokens, of_ids, of_texts = [], [], []
            for body in batch.column("body").to_pylist():
                ids = own.encode(body).tolist()
                n_tokens.append(len(ids))
                of_ids.append(hashlib.sha256(",".join([digits[i] for i in ids]).encode()).hexdigest())
                of_texts.append(hashlib.sha256(own.model.decode(ids).encode("utf-8") if ids else b"").hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n_tokens, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())],
                                             ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    seen = docs.select(F.col(key).alias("key"), as_text(F.col(text)).alias("body"))
    kind = seen.schema["key"].dataType.simpleString()
    return seen.mapInArrow(digests, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
