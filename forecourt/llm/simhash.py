"""Near-duplicates by SimHash, compared bit-sliced.

A fingerprint has a bit set if over half of the document's shingle hashes have it. To find all
pairs within ``radius`` bits, the 64 bits are cut into ``radius + 2`` blocks: such a pair agrees
in two of them at least, so it meets in one of the buckets keyed by two blocks (15 tables for a
radius of 4, with keys of about 21 bits). Only distinct fingerprints enter the buckets, so exact
copies cost nothing.

Within a task, rows sorted by bucket become vertical bit planes: Python integers in which bit i
belongs to row i. For each lag d, every row is compared with the row d places on, all at once:
a plane is XORed with itself shifted by d, and the differing bits are added up in carry-save
counters that overflow beyond the radius. When all rows in question have overflowed, the rest of
the planes is abandoned. Lags end when no row has a bucket neighbour that far on. A bucket gives
at most one link per member, to the smallest member it reaches.

A bucket of more than ``bucket`` fingerprints is cut into parts by hash, and each pair of parts is
a bucket of its own, so that no task holds more than two parts whatever the size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.llm.common import as_text, written
from forecourt.llm.components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
BUCKET = 8192
LANES = 8192
_AT_ONCE = 65536


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of the ASCII-lowered words' shingles, repeats included; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    starts, ends = starts[:n].tolist(), ends[width - 1:].tolist()
    for k in range(0, n, _AT_ONCE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k:k + _AT_ONCE], ends[k:k + _AT_ONCE])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    @F.pandas_udf("long")
    def of_texts(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return of_texts


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``row`` (all input columns) with ``fingerprint`` as a signed long; null reads as empty."""
    seen = docs.select(F.struct("*").alias("row"))
    return seen.withColumn("fingerprint", _fingerprints(shingle)(as_text(F.col("row").getField(text))))


def planes_of(values: np.ndarray) -> list[int]:
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return [int.from_bytes(x.tobytes(), "little") for x in np.packbits(bits.T, axis=1, bitorder="little")]


def _mask(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def within(planes: list[int], lag: int, asked: int, radius: int) -> int:
    """Rows of the mask ``asked`` whose distance to the row ``lag`` places on is at most ``radius``.

    The counters start so that they overflow at ``radius + 1``.
    """
    width = radius.bit_length()
    start = (1 << width) - 1 - radius
    counters = [asked if start >> k & 1 else 0 for k in range(width)]
    left = asked
    for at in range(0, len(planes), 8):
        for plane in planes[at:at + 8]:
            carry = (plane ^ (plane >> lag)) & left
            for k in range(width):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            left &= ~carry
        if not left:
            break
    return left


def link_rows(values: np.ndarray, same: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each row the first row of its bucket that it reaches; ``same[i]``: row i + 1 is in the bucket of row i."""
    n = len(values)
    planes, adjacent = planes_of(values), _mask(same)
    label, asked, lag = np.arange(n), adjacent, 1
    while asked:
        if found := within(planes, lag, asked, radius):
            rows = np.flatnonzero(np.unpackbits(np.frombuffer(found.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little"))
            while (apart := (a := label[rows]) != (b := label[rows + lag])).any():
                parent = np.arange(n)
                np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
                while ((up := parent[parent]) != parent).any():
                    parent = up
                label = parent[label]
        asked &= adjacent >> lag
        lag += 1
    return label


def _link_buckets(radius: int):
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches come sorted by bucket; a block ends where a bucket ends."""
        held = []

        def links_of(block: pd.DataFrame) -> pd.DataFrame:
            values = block["f"].to_numpy().astype(np.int64).view(np.uint64)
            of = block[["t", "key", "i", "j"]].to_numpy()
            label = link_rows(values, (of[1:] == of[:-1]).all(axis=1), radius)
            moved = np.flatnonzero(label != np.arange(len(label)))
            return pd.DataFrame({"a": values[moved].view(np.int64), "b": values[label[moved]].view(np.int64)})

        for batch in batches:
            for at in range(0, len(batch), LANES):
                held.append(batch.iloc[at:at + LANES])
                block = pd.concat(held, ignore_index=True)
                of = block[["t", "key", "i", "j"]].to_numpy()
                ends = np.flatnonzero((of[1:] != of[:-1]).any(axis=1))
                if len(ends):
                    yield links_of(block.iloc[:ends[-1] + 1])
                    block = block.iloc[ends[-1] + 1:]
                held = [block]
        if held:
            yield links_of(pd.concat(held, ignore_index=True))

    return link


def _key_masks(radius: int) -> list[int]:
    """For each pair of the ``radius + 2`` blocks, the mask of their bits as a signed long."""
    cuts = np.linspace(0, 64, radius + 3).round().astype(int)
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
    masks = [a | b for a, b in combinations(blocks, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def link_fingerprints(values: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links ``a, b`` that join all distinct fingerprints ``f`` within ``radius`` bits, at most one per row and bucket."""
    if not 1 <= radius <= 14:
        raise ValueError("radius must be between 1 and 14")
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("f").bitwiseAND(F.lit(m).cast("long")).alias("key"))
                       for t, m in enumerate(_key_masks(radius))])
    keyed = values.select("f", F.inline(tables))
    heavy = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket)
    heavy = written(heavy.select("t", "key", F.ceil(F.col("n") / bucket).cast("int").alias("parts")), "heavy-buckets")
    parts = F.coalesce("parts", F.lit(1))
    keyed = keyed.join(heavy, ["t", "key"], "left").select("t", "key", "f", parts.alias("parts"),
                                                           F.pmod(F.xxhash64("f"), parts).cast("int").alias("own"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    keyed = keyed.select("t", "key", "f", "own", other.alias("other"))
    keyed = keyed.select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "f")
    dealt = keyed.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "f")
    return dealt.mapInPandas(_link_buckets(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE,
                    radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``key, body_hash, fingerprint, component``: one row per document.

    Documents are linked if their fingerprints differ in ``radius`` bits or fewer; ``component`` is
    the smallest key reachable, itself included. ``body_hash`` tells rows of one key apart. Texts
    without words, null ones too, have fingerprint 0 and are linked like any other; repeated rows
    give repeated results; a component of null keys only has a null id; empty tables give no rows.
    """
    seen = fingerprints(docs, text, shingle).select(
        F.col("row").getField(key).alias("key"), F.xxhash64(as_text(F.col("row").getField(text))).alias("body_hash"), "fingerprint")
    seen = written(seen, "fingerprints")
    nodes = seen.groupBy(F.col("fingerprint").alias("f")).agg(F.min("key").alias("first"))
    nodes = written(nodes, "distinct-fingerprints")
    stars = components(link_fingerprints(nodes.select("f"), radius, bucket))
    members = stars.select(F.col("u").alias("f"), F.col("v").alias("root")).union(stars.select("v", "v").distinct())
    members = members.join(nodes, "f")
    ids = members.groupBy("root").agg(F.min("first").alias("component"))
    linked = members.select("f", "root").join(ids, "root").select("f", "component")
    classes = nodes.join(linked, "f", "left").select("f", F.coalesce("component", "first").alias("component"))
    return seen.join(classes, seen["fingerprint"] == classes["f"]).select("key", "body_hash", "fingerprint", "component")


def keep_one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE,
                     radius: int = RADIUS) -> DataFrame:
    """Rows of ``docs`` without near-duplicates: of each component the row of the smallest key stays.

    Rows equal in key and text count as one document. In a component of several rows with the
    smallest key, or with null keys only, the row with the smallest text hash stays.
    """
    found = near_duplicates(docs, text, key, shingle, radius)
    # rows of null keys have no common component id; their fingerprint stands in for it
    own = F.when(F.col("component").isNull(), F.col("fingerprint"))
    best = found.where(F.col("key").eqNullSafe(F.col("component"))).groupBy("key", own.alias("own")).agg(
        F.min("body_hash").alias("body_hash")).select(F.col("key").alias("kept_key"), F.col("body_hash").alias("kept_hash"))
    seen = docs.select(F.struct("*").alias("row"))
    seen = seen.select("row", F.col("row").getField(key).alias("key"), F.xxhash64(as_text(F.col("row").getField(text))).alias("body_hash"))
    kept = seen.join(best, (F.col("body_hash") == F.col("kept_hash")) & F.col("key").eqNullSafe(F.col("kept_key")), "left_semi")
    return kept.dropDuplicates(["key", "body_hash"]).select("row.*")


def hex_digits(column: str) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")
