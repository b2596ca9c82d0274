"""Documents into shards by best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts) are summed in Spark and counted by size; sizes keep their twelve leading bits, rounded up, so there
is a bounded number of size classes however large the table is, and each class says how many groups it has. Classes go in
descending order into the tightest bin that still holds a group of that size, found in a balanced tree of remaining
capacities. A bin that takes a group stays the tightest one until it is too full, so it takes its whole run of equal
groups at once; the bins come out as if groups were placed one by one. Groups of a class are then ranked in Spark, and
their rank says which run they belong to.

For a number of shards the smallest capacity that needs no more is searched, and a group larger than a fair share gets a
shard of its own, since groups are not divided. For a given capacity there are as many shards as best fit needs.
"""

from __future__ import annotations

from itertools import accumulate, groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt.llm.common import as_text, written

OVERHEAD = 16
#: Leading bits of a size that tell its class.
BITS = 12
LANES = 256


class BinTree:
    """Treap of (remaining capacity, bin); the priority is a mixed bin number, so the shape is reproducible."""

    __slots__ = ("left", "right", "key", "rank", "root")

    def __init__(self):
        self.left, self.right, self.key, self.rank, self.root = [], [], [], [], -1

    def _split(self, t: int, key: tuple[int, int]) -> tuple[int, int]:
        """Trees of the keys below ``key`` and of the rest."""
        if t < 0:
            return -1, -1
        if self.key[t] < key:
            a, b = self._split(self.right[t], key)
            self.right[t] = a
            return t, b
        a, b = self._split(self.left[t], key)
        self.left[t] = b
        return a, t

    def _merge(self, a: int, b: int) -> int:
        if a < 0 or b < 0:
            return max(a, b)
        if self.rank[a] > self.rank[b]:
            self.right[a] = self._merge(self.right[a], b)
            return a
        self.left[b] = self._merge(a, self.left[b])
        return b

    def add(self, remaining: int, number: int) -> None:
        node = number
        while len(self.key) <= node:
            self.key.append((0, 0))
            self.left.append(-1)
            self.right.append(-1)
            self.rank.append((len(self.rank) + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        self.key[node], self.left[node], self.right[node] = (remaining, number), -1, -1
        a, b = self._split(self.root, (remaining, number))
        self.root = self._merge(self._merge(a, node), b)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the tightest (remaining, bin) that holds ``size``."""
        a, b = self._split(self.root, (size, -1))
        if b < 0:
            self.root = a
            return None
        parent, t = -1, b
        while self.left[t] >= 0:
            parent, t = t, self.left[t]
        if parent < 0:
            b = self.right[t]
        else:
            self.left[parent] = self.right[t]
        self.root = self._merge(a, b)
        return self.key[t]


def best_fit(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """A bin for each size, which must come in descending order; None if more than ``most`` bins are needed."""
    tree, where, bins = BinTree(), [], 0
    for size in sizes:
        if size > capacity:
            return None
        if found := tree.take(size):
            remaining, number = found
        else:
            if bins == most:
                return None
            remaining, number, bins = capacity, bins, bins + 1
        tree.add(remaining - size, number)
        where.append(number)
    return where


def best_fit_runs(classes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[list[tuple[int, int]]] | None:
    """Runs ``(bin, groups)`` for each class ``(size, groups)``, sizes descending; None if more than ``most`` bins are needed.

    A size above the capacity takes a bin of its own for each group if there is no ``most``.
    """
    tree, where, bins = BinTree(), [], 0
    for size, count in classes:
        runs = []
        while count:
            if size > capacity:
                if most is not None:
                    return None
                runs += [(bins + k, 1) for k in range(count)]
                bins, count = bins + count, 0
                continue
            if found := tree.take(size):
                remaining, number = found
            else:
                if bins == most:
                    return None
                remaining, number, bins = capacity, bins, bins + 1
            run = min(count, remaining // size)
            tree.add(remaining - run * size, number)
            runs.append((number, run))
            count -= run
        where.append(runs)
    return where


def pack_runs_into(classes: list[tuple[int, int]], shards: int) -> list[list[tuple[int, int]]]:
    """Runs for each class (sizes descending), in shards as equal as best fit makes them."""
    rest, own, left = sum(size * count for size, count in classes), 0, list(classes)
    alone: list[list[tuple[int, int]]] = []
    while left and own < shards - 1 and left[0][0] * (shards - own) > rest:
        size, count = left[0]
        if not alone or len(alone) <= len(classes) - len(left):
            alone.append([])
        alone[-1].append((own, 1))
        own, rest, left[0] = own + 1, rest - size, (size, count - 1)
        if count == 1:
            left.pop(0)
    many = shards - own
    low = max(-(-rest // many), left[0][0] if left else 0, 1)
    step, tried = max(1, low // 10_000), {}

    def fits(k: int) -> bool:
        tried[k] = best_fit_runs(left, low + k * step, many)
        return tried[k] is not None

    high = 0
    while not fits(high):
        high = 2 * high + 1
    under = max((k for k, x in tried.items() if x is None), default=-1)
    while high - under > 1:
        middle = (high + under) // 2
        under, high = (under, middle) if fits(middle) else (middle, high)
    packed = [[(own + number, run) for number, run in runs] for runs in tried[high]]
    split = len(alone) + len(packed) - len(classes)  # a class that is partly alone has runs in both
    if split:
        packed[0] = alone.pop() + packed[0]
    return alone + packed


def pack_into(sizes: list[int], shards: int) -> list[int]:
    """A shard for each size (descending) so that shards are as equal as best fit makes them."""
    classes = [(size, len(list(same))) for size, same in groupby(sizes)]
    return [number for runs in pack_runs_into(classes, shards) for number, run in runs for _ in range(run)] if classes else []


def _class_of(size: Column) -> Column:
    """The size with its leading bits, rounded up."""
    unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size)) - (BITS - 1), F.lit(0))).cast("long")
    return (F.ceil(size / unit) * unit).cast("long")


def _ranked(rows: DataFrame, by: str, order: list[Column], lanes: int, lane: Column, name: str) -> DataFrame:
    """``rows`` with their rank from 0 within ``by``: numbered in lanes and shifted by the lanes before, so none holds all rows of a key."""
    laned = rows.withColumn("lane", F.pmod(lane, F.lit(lanes)).cast("int"))
    counts = written(laned.groupBy(by, "lane").agg(F.count("*").alias("n")), "lanes")
    before = Window.partitionBy(by).orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(by, "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = laned.withColumn("number", F.row_number().over(Window.partitionBy(by, "lane").orderBy(*order)) - 1)
    return numbered.join(offsets, [by, "lane"]).withColumn(name, (F.col("number") + F.col("offset")).cast("long")).drop("number", "offset", "lane")


def assign_shards(docs: DataFrame, shards: int = 40, text: str = "text", key: str = "doc_id", capacity: int | None = None,
                  lanes: int = LANES) -> DataFrame:
    """``row`` (all input columns) with ``size``, ``text_crc32``, ``shard`` and ``slot``.

    Size is the text's UTF-8 bytes plus 16; a null text has none and groups with empty ones. Equal
    texts, so repeated rows too, share a shard. With ``capacity`` (bytes) there are as many shards as needed and ``shards``
    does not count; a group above it gets a shard of its own. Slots number the rows of a shard from 0 without gaps.
    An empty table gives no rows. Tables written in the shared folder stand between the steps.
    """
    spark = docs.sparkSession
    body = as_text(F.col("row").getField(text))
    seen = docs.select(F.struct("*").alias("row")).select(
        "row", F.xxhash64(body).alias("group"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    groups = seen.groupBy("group").agg(F.sum("size").alias("bytes"))
    groups = written(groups.select("group", _class_of(F.col("bytes")).alias("class")), "groups")
    # leading bits bound the classes: 4,096 sizes and 2,048 more for each power of two beyond
    classes = sorted(map(tuple, groups.groupBy("class").agg(F.count("*").alias("n")).collect()), reverse=True)
    runs = best_fit_runs(classes, capacity) if capacity else pack_runs_into(classes, shards) if classes else []
    table = [(size, [(upto, number) for upto, (number, _) in zip(accumulate(run for _, run in own), own)]) for (size, _), own in zip(classes, runs)]
    table = written(spark.createDataFrame(table, "class long, runs array<struct<upto: long, shard: int>>"), "runs")
    placed = _ranked(groups, "class", [F.col("group")], lanes, F.col("group"), "rank").join(table, "class")
    mine = F.element_at(F.filter("runs", lambda r: F.col("rank") < r["upto"]), 1)["shard"]
    placed = written(placed.select("group", mine.alias("shard")), "shards-of-groups")
    dealt = seen.join(placed, "group").withColumn("_key", F.col("row").getField(key))
    numbered = _ranked(dealt, "shard", [F.col("_key"), F.col("group")], lanes, F.xxhash64("_key", "group"), "slot")
    return numbered.select("row", "size", "text_crc32", "shard", "slot")


def write_shards(assigned: DataFrame, path: str, lanes: int = LANES) -> None:
    """Rows of each shard in its folder, in order of slot within each file; no task holds a whole shard."""
    dealt = assigned.withColumn("part", (F.col("slot") % lanes).cast("int"))
    dealt.repartition("shard", "part").sortWithinPartitions("shard", "slot").drop("part").write.partitionBy("shard").parquet(path)
