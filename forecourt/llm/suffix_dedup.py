"""Repeated passages: every byte covered by a string of 100 bytes that also starts earlier.

A full suffix array of a corpus holds an entry for each byte. Here only suffixes that can repeat are sorted, and in
shards. The key of a window of 100 bytes is the smallest hash of the 24-byte strings in it, so equal windows have equal
keys, and some forty windows in a row share one (a stretch). A stretch whose key no other text has, nor another place
of its own text, holds nothing that repeats. The others travel as short records to the shard of their key, where their
suffixes are sorted by deep-shallow sorting: a multikey quicksort down to a shallow depth, all groups of a depth at once
and eight bytes to a character; groups that still agree there have long common prefixes and are ordered by blind tries.
In the sorted order equal windows stand together, and all but the earliest are marked.

Texts that are exact copies of an earlier one are marked whole and are not searched again. A key of very many texts is
first sorted in several shards; windows that are the earliest of theirs then meet by a digest of the window alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.llm.common import as_text, rows_of, written

WIDTH = 100
#: Texts with one key that a shard takes; more are dealt to several.
HOT = 4096
#: Bytes of text that are hashed at a time, so that their hashes stay in a core's cache; a longer text is taken in pieces.
_BLOCK = 1 << 17
#: Bytes of text whose keys are brought together before they are sent.
_AT_ONCE = 1 << 22
#: Bytes of records that are sorted at a time; a key is never cut.
_SORTED_AT_ONCE = 1 << 22
_GRAM = 24
_PLACE = np.uint64((1 << 23) - 1)
_SHALLOW = 40
_ROWS = 8192
_ODD = np.random.default_rng(7).integers(1, 2 ** 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as one number; ``data`` ends with eight bytes more than are asked for."""
    return np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data.data, strides=(1,))


def stretches(data: bytes, lengths: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """``key, doc, start, windows, alone`` of each stretch of ``data``, the joined texts of the given lengths.

    ``start`` counts within ``data``, which has fewer than 2 ** 23 bytes. ``alone`` is false if the key's string is at two
    places of the stretch, so that two of its own windows may be equal.
    """
    ends = np.cumsum(lengths)
    begins, n = ends - lengths, len(data)
    held = np.maximum(lengths - width + 1, 0)
    if not held.any():
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, bool))
    around = width - _GRAM + 1
    words = _words_at(np.frombuffer(data + bytes(8), np.uint8))
    size = n - _GRAM + 1
    hashes = np.zeros(size, np.uint64)
    for k in range(_GRAM // 8):
        part = words[8 * k:8 * k + size] * _ODD[k]
        part ^= part >> np.uint64(32)
        part *= _ODD[3]
        hashes += part
    hashes ^= hashes >> np.uint64(29)
    hashes *= _ODD[0]
    hashes ^= hashes >> np.uint64(32)
    # the least string of each window with its first place: leading bits of the hash above, the place below
    least, span = (hashes & ~_PLACE) | np.arange(size, dtype=np.uint64), 1
    while 2 * span <= around:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < around:
        least = np.minimum(least[:span - around], least[around - span:])
    place = (least & _PLACE).astype(np.int64)
    marks = np.zeros(n + 1, np.int32)
    some = held > 0
    marks[begins[some]] += 1
    np.add.at(marks, begins[some] + held[some], -1)
    whole = np.cumsum(marks[:len(least)]) > 0
    new = whole.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~whole[:-1]
    moved = np.flatnonzero(new[1:] & whole[:-1]) + 1
    new[moved[hashes[place[moved]] == hashes[place[moved - 1]]]] = False  # the same string again: the stretch goes on
    new[begins[some]] = True
    start = np.flatnonzero(new)
    doc = np.searchsorted(ends, start, side="right")
    windows = np.minimum(np.append(start[1:], n), (begins + held)[doc]) - start
    # equal windows have the string at the same distance, so a stretch with one place for it has no two
    return hashes[place[start]].view(np.int64), doc, start, windows, place[start] == place[start + windows - 1]


def _pieces(texts: list[bytes], width: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined up to a bounded size: ``data, lengths, texts' numbers, offsets``; very long ones in overlapping pieces."""
    parts, numbers, offsets, size = [], [], [], 0

    def joined():
        return b"".join(parts), np.array([len(p) for p in parts], np.int64), np.array(numbers, np.int64), np.array(offsets, np.int64)

    for number, text in enumerate(texts):
        for offset in range(0, max(len(text) - width + 1, 0), _BLOCK):
            part = text[offset:offset + _BLOCK + width - 1]
            if size + len(part) > _BLOCK and parts:
                yield joined()
                parts, numbers, offsets, size = [], [], [], 0
            parts.append(part)
            numbers.append(number)
            offsets.append(offset)
            size += len(part)
    if parts:
        yield joined()


def _keys(width: int):
    """Of each text's keys, those it shares with another of the batch or has twice (``known``), and one row per key of the batch."""

    def emit(key: np.ndarray, print_: np.ndarray, alone: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        order = np.lexsort((print_, key))
        key, print_, alone = key[order], print_[order], alone[order]
        new = np.append(True, (key[1:] != key[:-1]) | (print_[1:] != print_[:-1]))
        pair = np.flatnonzero(new)
        twice = (np.diff(np.append(pair, len(key))) > 1) | ~np.logical_and.reduceat(alone, pair)
        key, print_ = key[pair], print_[pair]
        one = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        many = np.diff(np.append(one, len(key)))
        known = np.repeat((many > 1) | np.logical_or.reduceat(twice, one), many)
        out = np.concatenate([key[one], key[known]]), np.concatenate([print_[one], print_[known]]), np.arange(len(one) + known.sum()) >= len(one)
        for at in range(0, len(out[0]), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(c[at:at + 65536]) for c in out], ["key", "print", "known"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("print").to_numpy(zero_copy_only=False)
            prints, first = np.unique(prints, return_index=True)  # copies of a text once
            bodies = batch.column("body").take(pa.array(first)).cast(pa.binary()).to_pylist()
            held, size = [], 0
            for data, lengths, numbers, _ in _pieces(bodies, width):
                key, doc, _, _, alone = stretches(data, lengths, width)
                held.append((key, prints[numbers[doc]], alone))
                size += len(data)
                if size >= _AT_ONCE:
                    yield from emit(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
            if held:
                yield from emit(*map(np.concatenate, zip(*held)))

    return found


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sorted by key and text) of keys that several texts have; one key's first row is held back, no more."""
    held = None

    def made(key: np.ndarray, print_: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(print_, pa.int64())], ["key", "print"])

    for batch in batches:
        key, print_, known = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if known.any():
            yield made(key[known], print_[known])
        key, print_ = key[~known], print_[~known]
        if held is not None:  # the row before, and whether its key is shared
            key, print_ = np.append(held[0], key), np.append(held[1], print_)
        if not len(key):
            continue
        same = key[1:] == key[:-1]
        other = same & (print_[1:] != print_[:-1])
        part = np.cumsum(np.append(0, ~same))
        shared = np.bincount(part, np.append(0, other), minlength=part[-1] + 1)[part] > 0
        if held is not None and held[2]:
            shared |= part == 0
        out = shared.copy()
        out[1:] &= (print_[1:] != print_[:-1]) | ~same
        if held is not None and held[2]:
            out[0] = False  # told already
        yield made(key[out], print_[out])
        held = key[-1], print_[-1], bool(shared[-1])


def _blind_trie(strings: list[bytes]) -> list[list[int]]:
    """Numbers of the strings (of equal length) in order, equal ones together.

    A node holds only the place where its strings differ. A string goes down blindly, is compared with one leaf, and
    the first place where they differ says where it branches off.
    """
    if strings.count(strings[0]) == len(strings):
        return [list(range(len(strings)))]  # a trie of one leaf
    root: list = [strings[0], [0]]  # a leaf: its string and the numbers of those equal to it
    for number in range(1, len(strings)):
        text, node = strings[number], root
        while type(node[1]) is dict:
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        if node[0] == text:
            node[1].append(number)
            continue
        differ = int.from_bytes(node[0], "big") ^ int.from_bytes(text, "big")
        place, own = len(text) - (differ.bit_length() + 7) // 8, node[0]
        above, node = None, root
        while type(node[1]) is dict and node[0] < place:
            above, node = node, node[1][text[node[0]]]
        leaf = [text, [number]]
        if type(node[1]) is dict and node[0] == place:
            node[1][text[place]] = leaf
        else:
            split = [place, {own[place]: node, text[place]: leaf}]
            if above is None:
                root = split
            else:
                above[1][text[above[0]]] = split
    out, open_ = [], [root]
    while open_:
        node = open_.pop()
        if type(node[1]) is dict:
            open_ += [node[1][c] for c in sorted(node[1], reverse=True)]
        else:
            out.append(node[1])
    return out


def deep_shallow(data: bytes, start: np.ndarray, group: np.ndarray, width: int, shallow: int = _SHALLOW) -> list[list[int]]:
    """Numbers of the strings ``data[start:start + width]`` that are equal, for each string of a ``group`` that is there twice or more."""
    chars = _words_at(np.frombuffer(data + bytes(8), np.uint8))
    at = np.arange(len(start))
    group = group.astype(np.int64)
    depth = 0
    while depth + 8 <= min(shallow, width) and len(at):
        char = chars[start[at] + depth].byteswap()
        order = np.lexsort((char, group))
        at, char, group = at[order], char[order], group[order]
        new = np.append(True, (group[1:] != group[:-1]) | (char[1:] != char[:-1]))
        group = np.cumsum(new)
        more = np.bincount(group)[group] > 1  # a string alone has its place
        at, group = at[more], group[more]
        depth += 8
    out = []
    edges = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(at) else np.empty(0, np.int64)
    from_, to, number = (start[at] + depth).tolist(), (start[at] + width).tolist(), at.tolist()
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(number)]):
        for leaf in _blind_trie([data[from_[k]:to[k]] for k in range(a, b)]):
            if len(leaf) > 1:
                out.append([number[a + k] for k in leaf])
    return out


_MARKS = "owner long, print long, begin long, end long, window binary"


def _sort(width: int):
    """Records in order of their shard: ``begin, end`` of bytes to remove, and windows of spread keys that are the earliest here."""

    def marked(rows: list[tuple]) -> Iterator[tuple]:
        # equal records first: all but the earliest are marked whole
        equal: dict[tuple, tuple] = {}
        for row in rows:
            shard, spread, owner, print_, at, windows, alone, body = row
            known = equal.get((shard, body))
            if known is None or (owner, print_, at) < known[2:5]:
                equal[shard, body] = row
                row = known
            elif (owner, print_, at) == known[2:5]:  # a repeated row
                row = None
            if row is not None:
                yield row[2], row[3], row[4], row[4] + row[5] - 1 + width, None
        held: dict[int, list[tuple]] = {}
        for row in equal.values():
            held.setdefault(row[0], []).append(row)
        sorted_ = [row for own in held.values() if len(own) > 1 or not own[0][6] for row in own]
        windows = np.array([row[5] for row in sorted_], np.int64)
        first = np.append(0, np.cumsum(windows))
        again = np.zeros(first[-1], bool)
        if sorted_:
            sizes = np.array([len(row[7]) for row in sorted_])
            base = np.cumsum(sizes) - sizes
            record = np.repeat(np.arange(len(sorted_)), windows)
            within = np.arange(first[-1]) - first[record]
            number = {shard: k for k, shard in enumerate(held)}
            group = np.array([number[row[0]] for row in sorted_])[record]
            order = sorted(range(len(sorted_)), key=lambda k: sorted_[k][2:5])
            document = np.append(0, np.cumsum([sorted_[a][2:4] != sorted_[b][2:4] for a, b in zip(order, order[1:])]))
            place = np.empty((len(sorted_), 2), np.int64)
            place[order, 0] = document
            place[:, 1] = [row[4] for row in sorted_]
            found = deep_shallow(b"".join(row[7] for row in sorted_), base[record] + within, group, width)
            same = np.array([k for equals in found for k in equals], np.int64)
            label = np.repeat(np.arange(len(found)), [len(equals) for equals in found])
            document, where = place[record[same], 0], place[record[same], 1] + within[same]
            order = np.lexsort((where, document, label))
            same, label, document, where = same[order], label[order], document[order], where[order]
            earliest = np.searchsorted(label, label)
            again[same[(document != document[earliest]) | (where != where[earliest])]] = True
        for k, row in enumerate(sorted_):
            flags = again[first[k]:first[k + 1]]
            if flags.any():
                steps = np.flatnonzero(np.diff(np.concatenate(([0], flags, [0])).astype(np.int8)))
                for a, b in zip(steps[::2].tolist(), steps[1::2].tolist()):
                    yield row[2], row[3], row[4] + a, row[4] + b - 1 + width, None
        told = {id(row): again[first[k]:first[k + 1]] for k, row in enumerate(sorted_)}
        for row in equal.values():
            if row[1]:
                flags = told.get(id(row))
                for k in range(row[5]):
                    if flags is None or not flags[k]:
                        yield row[2], row[3], row[4] + k, row[4] + k + width, hashlib.sha256(row[7][k:k + width]).digest()[:16]

    names, types = [f.split()[0] for f in _MARKS.split(", ")], [pa.int64()] * 4 + [pa.binary()]

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, out = [], 0, []

        def ready(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal out
            while out and len(out) >= least:
                part, out = out[:_ROWS], out[_ROWS:]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names)

        for batch in batches:
            for row in rows_of(batch):
                if size >= _SORTED_AT_ONCE and row[0] != rows[-1][0]:
                    out += marked(rows)
                    yield from ready(_ROWS)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[7])
        out += marked(rows)
        yield from ready(1)

    return sort


def _packed(docs: DataFrame) -> DataFrame:
    """``row, owner, print, text_hash, packed``: texts compressed, as joins by document move them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                bodies = pa.array([press.compress(b) for b in part.column("body").cast(pa.binary()).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], bodies], [*part.schema.names[:-1], "packed"])

    kept = [c for c in docs.columns if c != "body"]
    kind = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept, "body").mapInArrow(pack, f"{kind}, packed binary")


def _records(width: int):
    """Records of the stretches of each text whose key is on its list, with the shard of the key."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for whole in batches:
            for row in range(0, whole.num_rows, 512):
                batch = whole.slice(row, 512)
                owner, print_ = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("owner", "print"))
                lists = batch.column("keys")
                ends = lists.offsets.to_numpy()
                base = ends[0]
                wanted, parts = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                texts = [open_.decompress(b) for b in batch.column("packed").to_pylist()]
                ends = ends - base
                of = np.repeat(np.arange(len(texts)), np.diff(ends))
                order = np.lexsort((wanted, of))
                wanted, parts, of = wanted[order], parts[order], of[order]
                for data, lengths, numbers, offsets in _pieces(texts, width):
                    key, doc, start, windows, alone = stretches(data, lengths, width)
                    begins = np.cumsum(lengths) - lengths
                    at = np.empty(len(key), np.int64)
                    edges = np.searchsorted(doc, np.arange(len(numbers) + 1))
                    for k, d in enumerate(numbers.tolist()):  # each text has a list of its own
                        mine = slice(edges[k], edges[k + 1])
                        at[mine] = ends[d] + np.searchsorted(wanted[ends[d]:ends[d + 1]], key[mine])
                    inside = at < ends[numbers[doc] + 1]
                    asked = np.flatnonzero(inside & (wanted[np.minimum(at, len(wanted) - 1)] == key))
                    if not len(asked):
                        continue
                    text = numbers[doc[asked]]
                    some = parts[at[asked]]
                    own = print_[text]
                    with np.errstate(over="ignore"):
                        salt = (own % np.maximum(some, 1)).astype(np.uint64) * _ODD[2]
                    s, e = start[asked], start[asked] + windows[asked] - 1 + width
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[asked] ^ salt.view(np.int64)), pa.array(some > 1), pa.array(owner[text]), pa.array(own),
                         pa.array(s - begins[doc[asked]] + offsets[doc[asked]]), pa.array(windows[asked]), pa.array(alone[asked]),
                         pa.array([data[a:b] for a, b in zip(s.tolist(), e.tolist())], pa.binary())],
                        ["shard", "spread", "owner", "print", "at", "windows", "alone", "body"])

    return found


def _cut(width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n_bytes, spans, kept = [], [], []
                for packed, later, marks in zip(*(batch.column(c).to_pylist() for c in ("packed", "later", "marks"))):
                    text = open_.decompress(packed)
                    if later:
                        own = [(0, len(text))] if len(text) >= width else []
                    else:
                        own = []
                        for begin, end in sorted((m["begin"], m["end"]) for m in marks or ()):
                            if own and begin <= own[-1][1]:
                                own[-1] = own[-1][0], max(own[-1][1], end)
                            else:
                                own.append((begin, end))
                    left = memoryview(text)
                    n_bytes.append(len(text))
                    spans.append([{"begin": a, "end": b} for a, b in own])
                    kept.append(b"".join(left[a:b] for a, b in zip([0, *(b for _, b in own)], [*(a for a, _ in own), len(text)])))
                span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), pa.array(n_bytes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["row", "n_bytes", "removed", "kept"])

    return cut


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """``row, n_bytes, removed, kept``: the row of ``docs`` with its text's bytes, the spans taken out, and what is left.

    A byte goes if some string of ``width`` bytes that covers it also starts earlier: in a document of smaller ``key``
    (a whole number), or before in the same one. Strings are judged on the texts as given; those that overlap count,
    and none crosses documents. ``removed`` holds maximal spans as ``begin, end`` in bytes of UTF-8; ``kept`` is binary,
    as a span may end inside a character. Null texts are empty. A null key comes before all others; rows of one key with
    different texts are ordered by a hash of the text; repeated rows of one key and text are one document, whose
    answer each gets. An empty table gives no rows.
    """
    if width < 32:
        raise ValueError("strings have 32 bytes at least")
    owner = F.coalesce(F.col(key).cast("long"), F.lit(-2 ** 63))
    body = as_text(F.col(text))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"), owner.alias("owner"), body.alias("body"))
    rows = rows.withColumns({"print": F.xxhash64("body"), "text_hash": F.unhex(F.md5("body"))})
    keys = rows.select("print", "body").mapInArrow(_keys(width), "key long, print long, known boolean")
    dealt = F.when(F.col("known"), F.xxhash64("key", "print")).otherwise(F.col("key"))
    shared = written(keys.repartition(dealt).sortWithinPartitions("key", "print").mapInArrow(_shared, "key long, print long"), "shared-keys")
    first = written(rows.groupBy("print", "text_hash").agg(F.min("owner").alias("first")), "first-copies")
    often = shared.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    often = written(often.select("key", F.ceil(F.col("n") / hot).cast("long").alias("parts")), "frequent-keys")
    lists = shared.join(often, "key", "left").groupBy("print").agg(
        F.collect_set(F.struct("key", F.coalesce("parts", F.lit(1)).alias("parts"))).alias("keys"))
    lists = written(lists.join(first, "print").select(F.col("print").alias("print_"), F.col("text_hash").alias("text_hash_"), "first", "keys"), "key-lists")
    asked = _packed(rows.select("owner", "print", "text_hash", "body")).join(
        lists, (F.col("print") == F.col("print_")) & (F.col("text_hash") == F.col("text_hash_")) & (F.col("owner") == F.col("first")))
    records = asked.select("owner", "print", "packed", "keys").mapInArrow(
        _records(width), "shard long, spread boolean, owner long, print long, at long, windows long, alone boolean, body binary")
    marks = written(records.repartition("shard").sortWithinPartitions("shard").mapInArrow(_sort(width), _MARKS), "marks")
    # windows of spread keys: the earliest stays, whatever shard it was in
    place = F.struct("owner", "print", "begin")
    open_ = marks.where(F.col("window").isNotNull())
    least = open_.groupBy(F.col("window").alias("same")).agg(F.min(place).alias("least"), F.count("*").alias("n")).where("n > 1")
    late = open_.join(least, F.col("window") == F.col("same")).where(place != F.col("least")).select("owner", "print", "begin", "end")
    found = marks.where(F.col("window").isNull()).select("owner", "print", "begin", "end").unionByName(late)
    found = found.groupBy(F.col("owner").alias("owner_"), F.col("print").alias("print_")).agg(F.collect_list(F.struct("begin", "end")).alias("marks"))
    answers = first.join(found, (F.col("first") == F.col("owner_")) & (F.col("print") == F.col("print_")), "left")
    answers = written(answers.select(F.col("print").alias("print_"), F.col("text_hash").alias("text_hash_"), "first", "marks"), "answers")
    told = _packed(rows).join(answers, (F.col("print") == F.col("print_")) & (F.col("text_hash") == F.col("text_hash_")))
    kind = rows.schema["row"].dataType.simpleString()
    return told.select("row", "packed", (F.col("owner") > F.col("first")).alias("later"), "marks").mapInArrow(
        _cut(width), f"row {kind}, n_bytes long, removed array<struct<begin: long, end: long>>, kept binary")
