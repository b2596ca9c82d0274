"""Token ids of documents in Huffman-coded files, with blocks that decode on their own.

Ids are counted over all documents; their canonical code is an optimal prefix code of limited
length (package-merge), so the code lengths alone describe it and a table of ``2 ** limit``
entries decodes it. Only the counts of the vocabulary's ids reach the driver, whose number the
vocabulary bounds.

Documents are dealt by range of key and sorted, and each task writes its stretch as one file of
blocks of equally many ids: the code bits, the bit offset of every ``every``-th id as a
checkpoint, and an index of the document pieces in it. A block is decoded with all its checkpoints
at once: step k looks up the k-th id after each checkpoint in one vectorised table access.

A file is a Parquet file of such blocks, so that Spark's committer makes a lost task's files
whole again, and any store that Spark reaches can hold them.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from forecourt.llm.common import arrow_type, as_text, rows_of, shared_folder

LIMIT = 20
BLOCK = 262_144
EVERY = 128
#: Pieces kept for look-up until only those of the texts at hand are kept.
CACHE = 300_000


# Code


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of the best prefix code of at most ``limit`` bits for symbols with positive counts, in their order."""
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit codes of {limit} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.int64)[order]
    leaf_at, weights = [], leaves
    for level in range(limit):
        if level:
            pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
            both = np.concatenate((leaves, pairs))
            by = np.argsort(both, kind="stable")
            weights, is_leaf = both[by], by < n
        else:
            is_leaf = np.ones(n, bool)
        leaf_at.append(is_leaf)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(leaf_at):
        chosen = int(is_leaf[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical code of ``symbols`` with their lengths: shorter codes first, then smaller symbols."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((symbols, lengths))
        self.symbols, self.lengths = np.asarray(symbols, np.int64)[order], np.asarray(lengths, np.int64)[order]
        self.width = int(self.lengths.max()) if len(order) else 1
        share = np.int64(1) << (self.width - self.lengths)
        codes = (np.cumsum(share) - share) >> (self.width - self.lengths)
        top = int(self.symbols.max()) + 1 if len(order) else 1
        self.code_of, self.length_of = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.code_of[self.symbols], self.length_of[self.symbols] = codes, self.lengths
        self.table_symbol, self.table_length = np.zeros(1 << self.width, np.uint32), np.ones(1 << self.width, np.int64)
        filled = int(share.sum())
        self.table_symbol[:filled] = np.repeat(self.symbols, share)
        self.table_length[:filled] = np.repeat(self.lengths, share)

    def encode(self, ids: np.ndarray, every: int = EVERY) -> tuple[bytes, np.ndarray]:
        """The bits of ``ids``, and the bit offset of every ``every``-th one."""
        lengths = self.length_of[ids]
        offsets = np.cumsum(lengths) - lengths
        total = int(offsets[-1] + lengths[-1])
        word, room = offsets >> 5, 64 - lengths - (offsets & 31)
        bits = self.code_of[ids] << room.astype(np.uint64)
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        out = np.zeros((total >> 5) + 2, np.uint64)
        at = word[first]
        out[at] = np.add.reduceat(bits >> np.uint64(32), first)
        out[at + 1] += np.add.reduceat(bits & np.uint64(0xFFFFFFFF), first)
        return out.astype(">u4").tobytes()[: (total + 7) // 8], offsets[::every].copy()

    def decode(self, payload: bytes, n: int, checkpoints: np.ndarray, every: int = EVERY) -> np.ndarray:
        """The ``n`` ids of a block; all stretches between checkpoints advance together."""
        raw = np.concatenate((np.frombuffer(payload, np.uint8), np.zeros(4, np.uint8))).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        at = np.array(checkpoints, np.int64)
        last, shift, mask = len(window) - 1, 32 - self.width, (1 << self.width) - 1
        out = np.zeros((every, len(at)), np.uint32)
        for k in range(min(every, n)):
            entry = window[np.minimum(at >> 3, last)].astype(np.int64) >> (shift - (at & 7)) & mask
            out[k] = self.table_symbol[entry]
            at += self.table_length[entry]
        return out.T.reshape(-1)[:n]


def crc_of_parts(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of parts put together, each given by its own CRC-32 and its length in bytes.

    Appending n bytes multiplies the first part's remainder by x^(8n) modulo the CRC polynomial.
    """

    def times(a: int, b: int) -> int:
        product = 0
        for bit in range(31, -1, -1):
            if a >> bit & 1:
                product ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return product

    def power(n: int) -> int:
        result, square = 1 << 31, 1 << 23  # x^0 and x^8, lowest power in the highest bit
        while n:
            result = times(square, result) if n & 1 else result
            square, n = times(square, square), n >> 1
        return result

    total = 0
    for crc, length in parts:
        total = times(power(length), total) ^ crc
    return total


# Ids


#: Latin-1 as the rules class it: lower-case letters, numbers, and marks other than ``<``, which may begin a special token.
_LETTERS, _NUMBERS, _MARKS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", r"!-/:;=-@\[-`{-~¡-©«¬®-±´¶-¸»¿×÷"
ODD = f"[^{_LETTERS}{_NUMBERS}{_MARKS}]"
PIECE = f"('s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[{_MARKS}]+)"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pieces encoded as one text, and characters of text looked up at once.
JOINED, LOOKED_UP = 256, 1 << 22


class WordTokenizer:
    """Ids of a ``tokenizers`` file, looked up word by word if its rules never look across a space.

    Distinct words are cut into the pieces that the rules would cut them into, and pieces new to the table are encoded many in
    one text: the suffix that ends a piece tells them apart again. Words with other characters are pieces as they are.
    """

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.cache = path, cache
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = self._splits_at_spaces(spec)
        suffix = spec["model"].get("end_of_word_suffix")
        self.by_piece = self.by_word and bool(suffix) and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": SPLIT}
        if self.by_piece:
            # a piece is lower case, composed and cut already
            bare = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
            steps = [bare, *spec["pre_tokenizer"]["pretokenizers"][1:]]
            self.of_pieces = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": steps}}))
        vocabulary = (self.of_pieces if self.by_piece else self.tokenizer).get_vocab(with_added_tokens=True)
        self.size = len(vocabulary)
        self.width = "<u2" if self.size <= 1 << 16 else "<u4"
        self.is_end = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if self.by_piece:
            self.is_end[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        # the table of pieces: their spellings, their ids one after another, and how many ids each has
        self.known, self.ids, self.lengths = pa.array([""], pa.large_string()), np.zeros(0, self.width), np.zeros(1, np.int64)

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """The whole rules; plain pieces never need them."""
        return Tokenizer.from_file(self.path)

    @staticmethod
    def _splits_at_spaces(spec: dict) -> bool:
        """Normalisation by NFC, space runs and case only; words matched by a pattern without spaces; added tokens as they stand."""
        normal = (spec["normalizer"] or {}).get("normalizers", [])
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        return ({"NFC", "Lowercase"} <= {x["type"] for x in normal} and all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in normal)
                and bool(steps) and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
                and r"[^\s\p{L}\p{N}]+" in steps[0]["pattern"].get("Regex", "")
                and all(x["type"] == "ByteLevel" and not x["use_regex"] and not x["add_prefix_space"] for x in steps[1:])
                and not any(x["lstrip"] or x["rstrip"] or " " in x["content"] for x in spec["added_tokens"]))

    def _pack(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.width).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids by the whole rules, and their number per text."""
        packed = self._pack(texts)
        ids = np.frombuffer(b"".join(packed), self.width)
        return ids, np.fromiter(map(len, packed), np.int64, len(packed)) // ids.itemsize

    def _ids_of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and their number per piece: some hundred are one text, whose ids part after each that ends a piece."""
        at = np.append(np.arange(0, len(pieces), JOINED), len(pieces))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pieces), pa.scalar(" ", pieces.type))
        ids, lengths = [np.zeros(0, self.width)], [np.zeros(0, np.int64)]
        for i in range(0, len(texts), JOINED):
            for k, found in enumerate(self.of_pieces.encode_batch_fast(texts.slice(i, JOINED).to_pylist(), add_special_tokens=False), i):
                here = np.array(found.ids, self.width)
                count = np.diff(np.flatnonzero(self.is_end[here]), prepend=-1)
                if len(count) != at[k + 1] - at[k]:  # a character that the vocabulary lacks
                    here, count = self._ids_whole(pieces.slice(at[k], at[k + 1] - at[k]).to_pylist())
                ids.append(here)
                lengths.append(count)
        return np.concatenate(ids), np.concatenate(lengths)

    def _ids_of(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, and their number per piece; new ones are put in the table."""
        at = pc.index_in(distinct, self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            missing = distinct.take(pa.array(new))
            odd = pc.match_substring_regex(missing, ODD).to_numpy(zero_copy_only=False) if self.by_piece else np.ones(len(new), bool)
            plain, whole = (missing.filter(pa.array(x)) for x in (~odd, odd))
            parts = [self._ids_of_pieces(plain)] if len(plain) else []
            parts += [self._ids_whole(whole.to_pylist())] if len(whole) else []
            at[np.concatenate((new[~odd], new[odd]))] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, plain, whole])
            self.ids = np.concatenate((self.ids, *(x for x, _ in parts)))
            self.lengths = np.concatenate((self.lengths, *(x for _, x in parts)))
        ids, lengths = _in_lists(self.ids, self.lengths, at, np.arange(len(at) + 1))
        if len(self.known) > self.cache:
            self.known, self.ids, self.lengths = distinct, ids, lengths
        return ids, lengths

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as integers of ``width``."""
        if not self.by_word:
            return self._pack(texts)
        out: list[bytes] = []
        some, size = [], 0
        for t in texts:
            some.append(self._lower(t).replace("\n", " "))
            size += len(t)
            if size >= LOOKED_UP:
                out += self._looked_up(some)
                some, size = [], 0
        return out + self._looked_up(some) if some else out

    def _looked_up(self, texts: list[str]) -> list[bytes]:
        """Each distinct word of the texts is cut, and each distinct piece looked up, once; ids are copied to all their places."""
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        cut = words.dictionary
        if self.by_piece:
            mixed = pc.and_not(pc.match_substring_regex(cut, f"[^{_LETTERS}]"), pc.match_substring_regex(cut, ODD))
            cut = pc.replace_with_mask(cut, mixed, pc.utf8_rtrim(pc.replace_substring_regex(cut.filter(mixed), PIECE, r"\1 "), " "))
        cut = pc.split_pattern(cut, " ")
        pieces = cut.flatten().dictionary_encode()
        ids, lengths = self._ids_of(pieces.dictionary)
        ids, lengths = _in_lists(ids, lengths, pieces.indices.to_numpy(), cut.offsets.to_numpy())
        ids, lengths = _in_lists(ids, lengths, words.indices.to_numpy(), split.offsets.to_numpy())
        found, ends = ids.tobytes(), (np.cumsum(lengths) * ids.itemsize).tolist()
        return [found[a:b] for a, b in zip([0, *ends], ends)]

    @staticmethod
    def _lower(text: str) -> str:
        """Lower case where the rules would make it so letter by letter: within Latin-1, and not in a special token's spelling."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text if "<|" in text else text.lower()


def _in_lists(ids: np.ndarray, lengths: np.ndarray, which: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of lists of parts, and their number per list; ``ids`` has those of the parts, ``which`` the parts of all lists."""
    count = lengths[which]
    upto = np.concatenate(([0], np.cumsum(count)))
    # where each id comes from: the start of its part, and its number in it
    short = np.int32 if max(upto[-1], len(ids)) < 1 << 31 else np.int64
    places = np.repeat(((np.cumsum(lengths) - lengths)[which] - upto[:-1]).astype(short), count)
    places += np.arange(upto[-1], dtype=short)
    return ids[places], np.diff(upto[offsets - offsets[0]])


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def tokenize(docs: DataFrame, path: str, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, ids``: all ids of each text and the end id, packed as little-endian integers of 2 or 4 bytes."""

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        end = np.array([end_id], own.width).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = [x + end for x in own.encode_all(part.column("body").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(ids, pa.binary())], ["key", "ids"])

    seen = docs.select(F.col(key).alias("key"), as_text(F.col(text)).alias("body"))
    return seen.mapInArrow(ids_of, f"key {seen.schema['key'].dataType.simpleString()}, ids binary")


def count_ids(tokens: DataFrame, width: str) -> DataFrame:
    """``id, n`` over all documents; each task adds its own up first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = np.bincount(np.frombuffer(b"".join(batch.column("ids").slice(at, 512).to_pylist()), width))
                if len(found) > len(total):
                    total = np.pad(total, (0, len(found) - len(total)))
                total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# Files


def write_files(tokens: DataFrame, folder: str, width: str, limit: int = LIMIT, block: int = BLOCK, every: int = EVERY) -> None:
    """Writes ``folder/code`` (id, length) and ``folder/blocks``; files and blocks go by ascending key."""
    import pandas as pd  # here only, as tasks need no pandas and it takes some 40 MB of each Python worker

    spark = tokens.sparkSession
    counts = count_ids(tokens, width).toPandas().sort_values("id")  # at most one row per id of the vocabulary
    lengths = code_lengths(counts["n"].to_numpy(), limit)
    symbols = counts["id"].to_numpy().astype(np.int64)
    spark.createDataFrame(pd.DataFrame({"id": symbols, "length": lengths}), "id long, length long").coalesce(1).write.parquet(f"{folder}/code")
    kind = tokens.schema["key"].dataType.simpleString()
    shared = spark.sparkContext.broadcast((symbols, lengths))  # bounded by the vocabulary

    key_type = arrow_type(tokens, "key")
    doc_type = pa.struct([("key", key_type), ("doc", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("piece", pa.int32()), ("length", pa.int32())])
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int32()), ("payload", pa.binary()),
                        ("checkpoints", pa.list_(pa.int64())), ("docs", pa.list_(doc_type))])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = Code(*shared.value), TaskContext.get().partitionId()
        held, pieces, filled, number, doc, start = [], [], 0, 0, 0, 0

        def full() -> pa.RecordBatch:
            ids = np.concatenate(held)
            payload, checkpoints = code.encode(ids, every)
            names = ("key", "doc", "start", "n", "piece", "length")
            row = {"part": part, "block": number, "n_ids": len(ids), "payload": payload, "checkpoints": checkpoints,
                   "docs": [dict(zip(names, p)) for p in pieces]}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for key, packed in rows_of(batch):
                ids = np.frombuffer(packed, width)
                done = piece = 0
                while done < len(ids):
                    take = min(block - filled, len(ids) - done)
                    held.append(ids[done:done + take])
                    pieces.append((key, doc, start, len(ids), piece, take))
                    done, filled, piece = done + take, filled + take, piece + 1
                    if filled == block:
                        yield full()
                        held, pieces, filled, number = [], [], 0, number + 1
                doc, start = doc + 1, start + len(ids)
        if held:
            yield full()

    ordered = tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")
    ordered.select("key", "ids").mapInArrow(blocks, f"""part int, block int, n_ids int, payload binary, checkpoints array<long>,
        docs array<struct<key: {kind}, doc: long, start: long, n: long, piece: int, length: int>>""").write.parquet(f"{folder}/blocks")


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """``part, block, n_ids, payload, checkpoints, docs`` and ``offset``, the ids in all files before the block's."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("offset"))
    return blocks.join(offsets, "part")


def read_code(spark: SparkSession, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and code lengths; as many rows as the vocabulary has ids at most."""
    rows = spark.read.parquet(f"{folder}/code").toPandas()
    return rows["id"].to_numpy(np.int64), rows["length"].to_numpy(np.int64)


def decode_pieces(spark: SparkSession, folder: str, every: int = EVERY) -> DataFrame:
    """``key, part, doc, start, n, piece, ids`` decoded block by block; a document longer than a block has several pieces."""
    blocks = read_blocks(spark, folder)
    shared = spark.sparkContext.broadcast(read_code(spark, folder))
    kind = blocks.schema["docs"].dataType.elementType["key"].dataType.simpleString()

    key_type = to_arrow_type(blocks.schema["docs"].dataType.elementType["key"].dataType)
    types = {"key": key_type, "part": pa.int32(), "doc": pa.int64(), "start": pa.int64(), "n": pa.int64(), "piece": pa.int32(), "ids": pa.binary()}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(*shared.value)
        for batch in batches:
            for part, n_ids, payload, checkpoints, docs, offset in rows_of(batch):
                ids = code.decode(payload, n_ids, np.array(checkpoints, np.int64), every)
                at = np.cumsum([0, *(d["length"] for d in docs)])
                found = {"key": [d["key"] for d in docs], "part": [part] * len(docs), "doc": [d["doc"] for d in docs],
                         "start": [d["start"] + offset for d in docs], "n": [d["n"] for d in docs], "piece": [d["piece"] for d in docs],
                         "ids": [ids[a:b].astype("<u4").tobytes() for a, b in zip(at, at[1:])]}
                yield pa.RecordBatch.from_arrays([pa.array(found[k], t) for k, t in types.items()], list(types))

    return blocks.select("part", "n_ids", "payload", "checkpoints", "docs", "offset").mapInArrow(
        decode, f"key {kind}, part int, doc long, start long, n long, piece int, ids binary")


def digest_files(spark: SparkSession, folder: str, every: int = EVERY) -> DataFrame:
    """``key, start, n_tokens, ids_crc32`` of each document, read back from the files."""
    pieces = decode_pieces(spark, folder, every).select("key", "part", "doc", "start", "n", F.struct(
        "piece", F.crc32("ids").alias("crc"), F.octet_length("ids").alias("bytes")).alias("digest"))
    whole = pieces.groupBy("part", "doc", "key", "start", "n").agg(F.array_sort(F.collect_list("digest")).alias("parts"))
    kind = whole.schema["key"].dataType.simpleString()

    def crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x[0]["crc"] if len(x) == 1 else crc_of_parts([(p["crc"], p["bytes"]) for p in x]) for x in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    return whole.select("key", "start", F.col("n").alias("n_tokens"), "parts").mapInArrow(crcs, f"key {kind}, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, path: str, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Tokenizes, writes the files in the shared folder and returns their ``digest_files``.

    A null or empty text is the end id alone. Rows of one key follow each other by a hash of their
    ids, repeated rows included; null keys come first. An empty table gives empty files and no rows.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "token-files")
    # entropy coding in the column store as well: packed ids are otherwise stored as they are
    tokenize(docs, path, end_id, text, key).write.option("compression", "zstd").parquet(f"{folder}/ids")
    tokens = spark.read.parquet(f"{folder}/ids")
    write_files(tokens, folder, tokenizer(path).width)
    return digest_files(spark, folder)
