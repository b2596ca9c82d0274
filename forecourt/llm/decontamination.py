"""Benchmark passages in training text, found in a distributed positional inverted index.

Three steps. (1) The number of documents and places of every benchmark word is counted over the whole corpus.
(2) For each window of an item its rarest words are its anchors, and the index holds every
position of every anchor word in the corpus, with the words around it as numbers of benchmark
words (0 for any other word). (3) A posting of word w at position p, where item i has w at
position q, says that item i may start at p - q. Lists of (item, document, start) from the anchors
of a window are intersected, beginning with the rarest; what is left is compared word by word with
the neighbours held by the posting, so matches are exact without reading the text again.

The index depends on the words asked for only to leave out words nobody asks for: no posting of an anchor is cut,
however frequent. Rows are dealt by document and item, so a passage that a third of all documents
share is spread over all tasks.

The benchmark is handled in blocks of bounded size, each against all documents, so its words fit
in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.llm.common import as_text, written

WINDOW = 10
ANCHORS = 2
#: Benchmark words handled at a time.
BLOCK_WORDS = 500_000
_AT_ONCE_BYTES = 1 << 18

_TO_WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z in lower case."""
    return text.encode("utf-8").translate(_TO_WORDS).split()


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of texts ``body`` of a bounded size; a longer text is alone in one."""
    filled = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column("body")), 0).to_numpy(zero_copy_only=False)) // _AT_ONCE_BYTES
    cuts = np.flatnonzero(np.diff(filled)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


@dataclass
class Block:
    """Some benchmark items with their words as numbers from 1 on, and their windows."""

    ids: list
    words: dict[bytes, int]
    items: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple]) -> Block:
        words: dict[bytes, int] = {}
        items = [np.array([words.setdefault(w, len(words) + 1) for w in words_of(t or "")], np.int32) for _, t in rows]
        return cls([i for i, _ in rows], words, items)

    def windows(self, width: int) -> Iterator[tuple[int, int, int]]:
        """Item, start and length of each window; an item of fewer words than ``width`` is one window."""
        for number, item in enumerate(self.items):
            if len(item):
                for start in range(max(1, len(item) - width + 1)):
                    yield number, start, min(width, len(item))


def _count_words(block: Block):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(block.words) + 1, np.int64)
        known = block.words.get
        for batch in batches:
            for part in slices(batch):
                for body in part.column("body").to_pylist():
                    np.add.at(total, [n for w in words_of(body) if (n := known(w))], 1)
        seen = np.flatnonzero(total[1:]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["word", "n"])

    return count


def word_counts(bodies: DataFrame, block: Block) -> np.ndarray:
    """Places of each benchmark word in all documents; one row per benchmark word comes back."""
    rows = bodies.select("body").mapInArrow(_count_words(block), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(block.words) + 1, np.int64)
    for r in rows:
        counts[r["word"]] = r["n"]
    return counts


def anchors_of(block: Block, counts: np.ndarray, width: int = WINDOW, anchors: int = ANCHORS) -> dict[tuple[int, int], list[int]]:
    """For each window that can occur (item, start), the positions in the item of its rarest words, rarest first."""
    found = {}
    for number, start, length in block.windows(width):
        words = block.items[number][start:start + length]
        if counts[words].all():
            first = {}
            for at, w in enumerate(words):
                first.setdefault(int(w), start + at)
            rare = sorted(first, key=lambda w: (counts[w], w))[:anchors]
            found[number, start] = [first[w] for w in rare]
    return found


def index_documents(bodies: DataFrame, block: Block, anchors: dict[tuple[int, int], list[int]], width: int = WINDOW) -> DataFrame:
    """``key, body_hash, row_key, n_words, postings``: for each document all places of anchor words, with the words around.

    A posting is the word, its position and, for the rarest word of a window, the numbers of the
    ``width - 1`` words on either side (0 beyond the ends and for words of no item).
    """
    wanted, rarest = np.zeros(len(block.words) + 1, bool), np.zeros(len(block.words) + 1, bool)
    for (number, _), at in anchors.items():
        wanted[block.items[number][at]] = True
        rarest[block.items[number][at[0]]] = True

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, around = block.words.get, np.arange(1 - width, width)
        for whole in batches:
            for batch in slices(whole):
                n_words, word, place, near = [], [], [], []
                for body in batch.column("body").to_pylist():
                    words = words_of(body)
                    numbers = np.array([known(w, 0) for w in words], np.int32)
                    places = np.flatnonzero(wanted[numbers])
                    n_words.append(len(words))
                    word.append(numbers[places])
                    place.append(places)
                    centres = places[rarest[numbers[places]]] + width - 1
                    near.append(np.pad(numbers, width - 1)[centres[:, None] + around].astype(np.int32).reshape(-1))
                word = np.concatenate(word)
                sizes = np.concatenate(([0], np.cumsum(rarest[word] * len(around)))).astype(np.int32)
                posting = pa.StructArray.from_arrays(
                    [pa.array(word, pa.int32()), pa.array(np.concatenate(place), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(near), pa.int32()))], ["word", "at", "near"])
                ends = np.cumsum([0, *map(len, place)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), batch.column("body_hash"), batch.column("row_key"), pa.array(n_words, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), posting)], ["key", "body_hash", "row_key", "n_words", "postings"])

    kind = bodies.schema["key"].dataType.simpleString()
    return bodies.select("key", "body_hash", "row_key", "body").mapInArrow(
        index, f"key {kind}, body_hash long, row_key long, n_words long, postings array<struct<word: int, at: long, near: array<int>>>")


def _starts(index: DataFrame, block: Block, anchors: dict[tuple[int, int], list[int]]) -> DataFrame:
    """``row_key, item, start, q, near``: where a posting says that an item starts, as it has the word at ``q``."""
    places = sorted({(int(block.items[i][q]), i, q) for (i, _), qs in anchors.items() for q in qs})
    lookup = index.sparkSession.createDataFrame(places, "word int, item int, q int")  # at most one row per word of the block
    postings = index.where(F.size("postings") > 0).select("row_key", F.inline("postings"))
    return postings.join(F.broadcast(lookup), "word").select("row_key", "item", (F.col("at") - F.col("q")).alias("start"), "q", "near")


def _needed(index: DataFrame, anchors: dict[tuple[int, int], list[int]]) -> DataFrame:
    rows = [(i, s, qs[0], qs) for (i, s), qs in anchors.items()]
    return F.broadcast(index.sparkSession.createDataFrame(rows, "item int, window int, q int, anchors array<int>"))


def _occurrences(index: DataFrame, block: Block, anchors: dict[tuple[int, int], list[int]], width: int) -> DataFrame:
    """``row_key, item, at, n``: windows of items found word by word, at a word position and ``n`` words long."""
    starts = _starts(index, block, anchors)
    met = starts.groupBy("row_key", "item", "start").agg(F.collect_set("q").alias("there"))
    rarest = starts.join(_needed(index, anchors), ["item", "q"])
    both = rarest.join(met, ["row_key", "item", "start"]).where(F.size(F.array_except("anchors", "there")) == 0)
    items = block.items

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept, lengths = [], []
            for item, q, near, window in zip(batch["item"], batch["q"], batch["near"], batch["window"]):
                words = items[item][window:window + width]
                first = width - 1 + window - q
                kept.append(np.array_equal(np.asarray(near)[first:first + len(words)], words))
                lengths.append(len(words))
            found = pd.DataFrame({"row_key": batch["row_key"], "item": batch["item"], "at": batch["start"] + batch["window"], "n": lengths})
            yield found[np.array(kept, bool)]

    return both.select("row_key", "item", "start", "q", "near", "window").mapInPandas(compare, "row_key long, item int, at long, n int")


def _near_occurrences(index: DataFrame, block: Block, anchors: dict[tuple[int, int], list[int]], slop: int) -> DataFrame:
    """``row_key, item``: some window's anchors all occur, their places off by ``slop`` words at most between any two.

    A start falls into a stretch of ``slop + 1`` and the stretch before, so starts that close meet in one.
    """
    starts = _starts(index, block, anchors)
    step = F.floor(F.col("start") / (slop + 1))
    dealt = starts.select("row_key", "item", "start", "q", F.explode(F.array(step, step - 1)).alias("stretch"))
    lists = dealt.groupBy("row_key", "item", "stretch").agg(F.collect_set(F.struct("start", "q")).alias("there"))
    wanted = _needed(index, anchors).select("item", "window", "anchors")
    # from each place of the rarest word or another anchor on, all anchors within `slop`
    close = F.expr(f"""exists(there, a -> size(array_except(anchors,
        transform(filter(there, b -> b.start BETWEEN a.start AND a.start + {int(slop)}), b -> b.q))) = 0)""")
    return lists.join(wanted, "item").where(close).select("row_key", "item").distinct()


def _blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[Block]:
    rows = benchmark.select(F.col(item).alias("item"), as_text(F.col(text)).alias("body"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    parts = max(1, -(-size // (2 * most)))  # a word and the space after it have two bytes at least
    for part in range(parts):
        mine = rows.where(F.pmod(F.xxhash64("item", "body"), F.lit(parts)) == part) if parts > 1 else rows
        yield Block.of([(r[0], r[1]) for r in mine.collect()])


def _bodies(docs: DataFrame, text: str, key: str) -> DataFrame:
    bodies = docs.select(F.col(key).alias("key"), as_text(F.col(text)).alias("body"))
    return bodies.withColumns({"body_hash": F.xxhash64("body"), "row_key": F.xxhash64("key", "body")})


def _named(block: Block, index: DataFrame) -> DataFrame:
    rows = [(n, None if i is None else str(i)) for n, i in enumerate(block.ids)]
    return F.broadcast(index.sparkSession.createDataFrame(rows, "item int, name string"))  # items of one block


def find_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id",
                  item_text: str = "text", width: int = WINDOW, anchors: int = ANCHORS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``key, body_hash, n_words, n_hit, n_items, items, contaminated``: one row per document.

    A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is
    one window. ``n_hit`` counts the words of the document inside any occurrence of a window,
    ``items`` holds the ids (as strings, sorted) of the items with one. Null texts have no words;
    repeated rows give repeated results; repeated items count by their id; an empty table of
    documents gives no rows and an empty benchmark no hits. Items with a null id are hit but not listed.
    """
    bodies, base, found = _bodies(docs, text, key), None, None
    for block in _blocks(benchmark, item, item_text, block_words):
        windows = anchors_of(block, word_counts(bodies, block), width, anchors)
        index = written(index_documents(bodies, block, windows, width), "postings")
        base = index.select("key", "body_hash", "row_key", "n_words") if base is None else base
        hits = _occurrences(index, block, windows, width).join(_named(block, index), "item").select("row_key", "name", "at", "n")
        found = hits if found is None else found.unionByName(hits)
    found = written(found, "occurrences")
    words = found.select("row_key", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("at")).distinct()
    hit = words.groupBy("row_key").agg(F.count("*").alias("n_hit"))
    names = found.select("row_key", "name").distinct().groupBy("row_key").agg(F.array_sort(F.collect_list("name")).alias("items"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return base.join(hit, "row_key", "left").join(names, "row_key", "left").select(
        "key", "body_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"), listed.alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def find_near_passages(docs: DataFrame, benchmark: DataFrame, slop: int = 5, text: str = "text", key: str = "doc_id", item: str = "item_id",
                       item_text: str = "text", width: int = WINDOW, anchors: int = ANCHORS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``key, body_hash, item``: proximity matches, documents with the rarest words of some window almost in place.

    Against their places in the item, the words may be ``slop`` words apart. Nulls and empty tables as in ``find_passages``.
    """
    bodies, found = _bodies(docs, text, key), None
    for block in _blocks(benchmark, item, item_text, block_words):
        windows = anchors_of(block, word_counts(bodies, block), width, anchors)
        index = written(index_documents(bodies, block, windows, width), "postings")
        hits = _near_occurrences(index, block, windows, slop).join(_named(block, index), "item")
        hits = hits.join(index.select("key", "body_hash", "row_key").distinct(), "row_key").select("key", "body_hash", F.col("name").alias("item"))
        found = hits if found is None else found.unionByName(hits)
    return found.distinct()


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **settings) -> DataFrame:
    """Rows of ``docs`` without a word of any benchmark window; settings as in ``find_passages``."""
    hit = find_passages(docs, benchmark, text, key, **settings).where("contaminated").select(F.col("key").alias("hit_key"), F.col("body_hash").alias("hit_hash")).distinct()
    seen = docs.select(F.struct("*").alias("row"))
    seen = seen.select("row", F.col("row").getField(key).alias("key"), F.xxhash64(as_text(F.col("row").getField(text))).alias("body_hash"))
    return seen.join(written(hit, "contaminated"), (F.col("body_hash") == F.col("hit_hash")) & F.col("key").eqNullSafe(F.col("hit_key")), "left_anti").select("row.*")
