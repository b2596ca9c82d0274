import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from forecourt.llm import periodic_runs, prefix_trie, queries

from . import brute
from .helpers import LONG, TEXTS, documents


def test_runs_equal_every_period_tried():
    random.seed(1)
    for _ in range(600):
        n, letters = random.randint(0, 60), random.randint(1, 4)
        words = [random.randint(0, letters) for _ in range(n)]
        if n and random.random() < 0.5:
            period, start = random.randint(1, max(1, n // 3)), random.randint(0, n - 1)
            words = words[:start] + [words[start + (i - start) % period] if start + period <= n else 7 for i in range(start, n)]
        least = random.choice([2, 12])
        assert [tuple(map(int, r)) for r in periodic_runs.runs_of(np.array(words, np.int64), least)] == brute.runs(words, least)


def test_agreement_of_suffixes():
    random.seed(2)
    for text in ([random.randint(1, 2) for _ in range(200)], [1] * 100, [1, 2, 3] * 40):
        tree = periodic_runs.SuffixTree(text)
        i, j = np.array([(a, b) for a in range(len(text)) for b in range(len(text)) if a != b]).T
        want = [next((k for k in range(len(text)) if max(a, b) + k >= len(text) or text[a + k] != text[b + k])) for a, b in zip(i, j)]
        assert tree.agree(i, j).tolist() == want
        assert sorted(range(len(text)), key=lambda k: text[k:]) == np.argsort(tree.rank[:-1]).tolist()


def run_rows(rows):
    out = []
    for key, text in rows:
        words = brute.with_periods(key, text)
        runs = brute.runs(words)
        dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        out.append((key, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, brute.sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)),
                    brute.sha(" ".join(w for i, w in enumerate(words) if i not in dropped))))
    return out


def test_word_runs_equal_brute_force(spark, sf_dir):
    got = queries.word_runs(spark, sf_dir).collect()
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if len(r[1] or "") < 12_000]
    kept = {k for k, _ in rows}
    assert sorted(map(str, run_rows(rows))) == sorted(str(tuple(r)) for r in got if r["doc_id"] in kept)
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_runs_of_awkward_rows(spark):
    again = "x y z " * 20
    rows = [r for r in TEXTS if r[1] != LONG] + [(50, again), (51, "a " * 12), (52, "a " * 11), (53, "b " + again + "b a\n" * 9), (54, "p\u00a0q " * 12)]
    got = periodic_runs.find_runs(documents(spark, rows)).select("row.doc_id", "row.key", "n_words", "runs", "collapsed").collect()
    for (key, text), r in zip(rows, got):
        words = brute.split(text)
        assert (r["doc_id"], r["key"], r["n_words"], [tuple(x) for x in r["runs"]]) == (key, "x", len(words), brute.runs(words))
    assert {r["doc_id"]: r["collapsed"] for r in got}[50] == "x y z"
    alone = spark.createDataFrame([(again,)], "text string")
    assert periodic_runs.find_runs(alone).select("collapsed").first()[0] == "x y z"
    assert periodic_runs.find_runs(documents(spark, [])).count() == 0
    long = periodic_runs.find_runs(documents(spark, [(1, LONG)] * 2)).select("n_words", F.size("runs")).collect()
    assert [tuple(r) for r in long] == [(90_000, 1)] * 2  # the numbers come round again after 977 * 3 words


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, 6) for r in rows], "conv_id long, turn long, role string, text string, head string, depth int, n int")


def conversations(seed, many):
    random.seed(seed)
    rows = []
    for c in range(many):
        start = [("user", "hello there")] * random.randint(0, 3) if c % 3 else []
        said = start + [(random.choice(["user", "assistant", None]), random.choice(["a b", "c", "", None, "d e f"])) for _ in range(random.randint(0, 4))]
        rows += [(c, t, r, x) for t, (r, x) in enumerate(said)]
    rows += [(40, None, "user", "first"), (40, 2, "user", "tie one"), (40, 2, "user", "tie two"), (40, 2, "user", "tie two"), (None, 0, "user", "none"),
             (2**53 + 1, 0, "user", "hello there")]
    return rows


@pytest.mark.parametrize("burst", [1, 3, 40, 1000])
def test_trie_equals_brute_force(spark, burst):
    rows = conversations(burst, 120)
    lists = queries.rebuilt(prefix_trie.turn_lists(turns(spark, rows)))
    got = prefix_trie.conversation_trie(lists, burst).select(
        "first", "depth", "parent_first", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute.trie(brute.rebuilt(rows))))


def test_containers_burst_and_hold_few(spark):
    rows = conversations(5, 200) + [(1000 + c, t, "user", f"same {t}" if t < 30 else f"own {c}") for c in range(20) for t in range(31)]
    distinct, _ = prefix_trie.sequences(prefix_trie.turn_lists(turns(spark, rows)))
    held = prefix_trie.containers(distinct, 5)
    assert held.groupBy("head").count().agg(F.max("count")).first()[0] <= 5
    assert held.count() == distinct.count() and held.agg(F.max("depth")).first()[0] == 31


def test_ends_of_many_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_CHUNK_BYTES", 100)
    ends = spark.range(500).select(F.lit(b"one").alias("end"), F.col("id").alias("conv")).unionByName(spark.createDataFrame([(b"two", 7)], "end binary, conv long"))
    got = {bytes(r["end"]): r["sha256"] for r in prefix_trie.ends_digests(ends).collect()}
    assert got == {b"one": brute.sha(",".join(map(str, range(500)))), b"two": brute.sha("7")}


def test_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(prefix_trie.turn_lists(turns(spark, []))).count() == 0
