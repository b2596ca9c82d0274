import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from forecourt.llm import quality_rules, sharding, url_rules
from forecourt.llm.queries import URL_RULES

from .helpers import LONG, TEXTS, documents


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality_measures_equal_brute_force(spark):
    texts = [t for _, t in TEXTS] + ["a b c d e a b c d e f", "x x x x x x", "# $ 5% & | <>", "l\nl\n\n \nl", "a b c d e f g a b c d e f g h"]
    df = documents(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r for r in quality_rules.judge_texts(df).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:6] == measures(t), t
        n, _, _, _, again = measures(t)
        assert got[i]["base_failed"] == (n < 10 or 100 * again > 20 * n)
    assert got[0]["kept"] and not got[4]["kept"]


def test_quality_rules_run_without_python_or_shuffle(spark):
    plan = quality_rules.judge_texts(documents(spark)).where("kept")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)
    assert quality_rules.judge_texts(documents(spark, [])).count() == 0


def test_failed_rules_name_the_measure(spark):
    rows = [(1, "%%% ### the of and in to is it on aaa bbbb cccc dddd eee fff"), (2, "der\n" * 30)]
    got = {r["doc_id"]: r["failed"] for r in quality_rules.judge_texts(documents(spark, rows)).select("row.doc_id", "failed").collect()}
    assert got == {1: ["symbols_to_words"], 2: ["repeated_lines", "repeated_words"]}


def judged(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, "allow"))


URLS = ["http://www.example.com/en/1?x", "https://Example.com/en/", "http://a.b.example.com/en", "http://xexample.com/en/2", "http://com", "http://com/",
        "ftp://x.net/es/1", "http://x.net/fr/#a", "http://net/de/", "no scheme", "", None, "://", "http:///path", "http://a..com/", "http://ÉX.NET/es/", "a://b://c.com/x"]


def test_url_rules_equal_brute_force(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    got = url_rules.judge_urls(df, rules, lanes=3).select("row.page_id", "host", "path", "rule", "verdict").collect()
    assert len(got) == 2 * len(URLS)
    for i, *rest in map(tuple, got):
        assert tuple(rest) == judged(URLS[i % len(URLS)]), URLS[i % len(URLS)]


def test_url_rules_of_nothing(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_rules.judge_urls(df, none).select("rule", "verdict").first() == (None, "allow")
    assert url_rules.judge_urls(df.limit(0), none).count() == 0
    plan = url_rules.judge_urls(df, none)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_best_fit_takes_the_tightest_bin():
    assert sharding.best_fit([6, 5, 4, 3, 2], 10) == [0, 1, 0, 1, 1]
    assert sharding.best_fit([7, 6, 3, 2], 10) == [0, 1, 0, 1]
    assert sharding.best_fit([5, 5, 5], 10, most=1) is None and sharding.best_fit([11], 10) is None
    tree, free = sharding.BinTree(), {}
    random.seed(5)
    for k in range(3000):
        if random.random() < 0.6:
            free[k] = random.randint(1, 500)
            tree.add(free[k], k)
        else:
            size = random.randint(1, 500)
            want = min(((r, n) for n, r in free.items() if r >= size), default=None)
            assert tree.take(size) == want
            if want:
                del free[want[1]]


def test_packing_is_even_and_whole():
    sizes = sorted((17 * i * i % 1009 + 1 for i in range(4000)), reverse=True)
    where = sharding.pack_into(sizes, 40)
    load = Counter()
    for s, b in zip(sizes, where):
        load[b] += s
    assert set(load) == set(range(40)) and max(load.values()) - min(load.values()) < 0.01 * sum(sizes) / 40
    huge = sharding.pack_into([10_000, *[1] * 390], 40)
    assert huge.count(huge[0]) == 1 and max(Counter(huge[1:]).values()) == 10


def test_runs_fill_bins_as_groups_one_by_one():
    random.seed(9)
    for _ in range(200):
        sizes = sorted((random.randint(1, 30) for _ in range(random.randint(1, 150))), reverse=True)
        capacity = random.randint(30, 80)
        classes = [(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)]
        one, runs = sharding.best_fit(sizes, capacity), sharding.best_fit_runs(classes, capacity)
        assert [n for own in runs for n, count in own for _ in range(count)] == one
        shards = random.randint(1, 9)
        packed = sharding.pack_runs_into(classes, shards)
        assert [sum(c for _, c in own) for own in packed] == [n for _, n in classes] and {n for own in packed for n, _ in own} <= set(range(shards))


def test_every_group_is_packed_whatever_its_share(spark):
    """Many small groups, where no single one is a noticeable share of a shard."""
    random.seed(10)
    texts = ["t" * random.randint(0, 300) + str(i) for i in range(3000)] + ["copied text"] * 700 + [None, ""]
    rows = list(enumerate(texts))
    got = sharding.assign_shards(documents(spark, rows), shards=7).select("row.doc_id", "row.text", "size", "shard", "slot").collect()
    load, slots, of = [0] * 7, {}, {}
    for r in got:
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert of.setdefault(r["text"] or "", r["shard"]) == r["shard"]
    assert sorted(r["doc_id"] for r in got) == [i for i, _ in rows]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and max(load) - min(load) < 0.002 * sum(load) / 7 + 40
    full = sharding.assign_shards(documents(spark, rows), capacity=20_000).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert max(r["n"] for r in full) <= 20_000 and len(full) <= -(-sum(load) // 20_000) + 1


def test_shards(spark):
    got = sharding.assign_shards(documents(spark, TEXTS * 3), shards=4).select("row.doc_id", "row.text", "row.size", "size", "text_crc32", "shard", "slot").collect()
    assert len(got) == 3 * len(TEXTS)
    by_text, slots = {}, {}
    for doc, text, _, size, crc, shard, slot in map(tuple, got):
        body = (text or "").encode()
        assert size == len(body) + 16 and crc == zlib.crc32(body)
        assert by_text.setdefault(text or "", shard) == shard
        slots.setdefault(shard, []).append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    assert sharding.assign_shards(documents(spark, [])).count() == 0
    assert len(LONG) > 100_000


def test_written_shards_read_back(spark, tmp_path):
    assigned = sharding.assign_shards(documents(spark), shards=3, lanes=2)
    sharding.write_shards(assigned, str(tmp_path / "out"), lanes=2)
    back = spark.read.parquet(str(tmp_path / "out")).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    assert sum(r["n"] for r in back) == len(TEXTS) and all(r["last"] == r["n"] - 1 for r in back)


@pytest.mark.parametrize("shards", [1, 7])
def test_few_documents_in_many_shards(spark, shards):
    got = sharding.assign_shards(documents(spark, [(1, "a"), (2, "b")]), shards=shards).collect()
    assert len(got) == 2 and all(0 <= r["shard"] < shards for r in got)
