import random

import numpy as np
import pytest

from forecourt.llm import suffix_dedup

from . import brute
from .helpers import LONG, TEXTS, documents


def words(many):
    return " ".join(random.choice(["ab", "cé", "def", "gh日", "i"]) + str(random.randint(0, 9)) for _ in range(many))


def corpus(seed):
    """Copies, passages at other places, repeats within a text, one letter over and over, texts just as long as a string."""
    random.seed(seed)
    base = [words(random.randint(1, 120)) for _ in range(12)]
    passage = words(60)
    rows = list(enumerate(base))
    rows += [(100 + i, t) for i, t in enumerate(base[:4] * 3)]
    rows += [(200 + i, words(i) + " " + passage[random.randint(0, 40):] + words(i)) for i in range(40)]
    rows += [(300, "a" * 400), (301, "a" * 150 + "b"), (302, "xyz" * 90), (303, passage + passage), (304, base[5][:100]), (-5, base[6]), (305, (words(20) + "\n") * 5)]
    return rows


def want(rows, width):
    """Rows of one id and text are one document; null ids come first, ties of an id by text hash are not asked for here."""
    texts = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    data = [t.encode() for _, t in texts]
    found = {}
    for r, d, mark in zip(texts, data, brute.repeats(data, width)):
        edges = [k for k in range(len(d) + 1) if (mark[k] if k < len(d) else 0) != (mark[k - 1] if k else 0)]
        found[r] = len(d), list(zip(edges[::2], edges[1::2])), bytes(b for b, x in zip(d, mark) if not x)
    return [(i, *found[i, t or ""]) for i, t in rows]


@pytest.mark.parametrize("seed, width, hot", [(1, 100, 4096), (2, 100, 3), (3, 32, 4096), (4, 32, 2), (5, 101, 5)])
def test_repeats_equal_brute_force(spark, seed, width, hot):
    rows = corpus(seed) + [(7, None), (8, ""), (9, "short"), (100, corpus(seed)[0][1]), (None, words(50))]
    got = suffix_dedup.remove_repeats(documents(spark, rows), width=width, hot=hot).select("row.doc_id", "row.key", "n_bytes", "removed", "kept").collect()
    assert {r["key"] for r in got} == {"x"}
    assert sorted(map(str, want(rows, width))) == sorted(str((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["removed"]], bytes(r["kept"]))) for r in got)


def test_repeats_in_awkward_rows(spark):
    got = suffix_dedup.remove_repeats(documents(spark)).select("row.doc_id", "n_bytes", "removed", "kept").collect()
    assert len(got) == len(TEXTS)
    assert sorted((r["n_bytes"] for r in got)) == sorted(len((t or "").encode()) for _, t in TEXTS)
    long = next(r for r in got if r["doc_id"] == 6)
    mark = brute.repeats([LONG.encode()])[0]
    assert sum(e - b for b, e in long["removed"]) == sum(mark)
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0


def test_texts_of_several_pieces(spark):
    rng = np.random.default_rng(1)
    letters = np.frombuffer(b"abcdefghijklmnop", np.uint8)
    long = letters[rng.integers(0, 16, suffix_dedup._AT_ONCE + 200_000)].tobytes().decode()
    edge = suffix_dedup._AT_ONCE
    rows = [(1, "q" + long[edge - 700:edge + 900] + "q"), (2, long), (3, "r" + long[-300:] + "r")]
    got = {r["doc_id"]: [tuple(s) for s in r["removed"]] for r in suffix_dedup.remove_repeats(documents(spark, rows)).select("row.doc_id", "removed").collect()}
    assert got == {1: [], 2: [(edge - 700, edge + 900)], 3: [(1, 301)]}


def test_deep_shallow_groups_equal_strings():
    random.seed(6)
    for _ in range(200):
        data = "".join(random.choice("ab") if random.random() < 0.1 else "a" for _ in range(400)).encode()
        start = np.array(random.sample(range(300), 120))
        group = np.array([random.randint(0, 2) for _ in start])
        got = sorted(sorted(int(x) for x in g) for g in suffix_dedup.deep_shallow(data, start, group, 64, shallow=16))
        by = {}
        for k, (s, g) in enumerate(zip(start, group)):
            by.setdefault((g, data[s:s + 64]), []).append(k)
        assert got == sorted(v for v in by.values() if len(v) > 1)
        strings = [data[s:s + 64] for s in start]
        order = [k for leaf in suffix_dedup._blind_trie(strings) for k in leaf]
        assert [strings[k] for k in order] == sorted(strings)


def test_equal_windows_have_equal_keys():
    random.seed(7)
    passage = words(200).encode()
    texts = [words(30).encode() + passage, passage + words(10).encode(), b"a" * 300, b""]
    key, doc, start, windows, alone = suffix_dedup.stretches(b"".join(texts), np.array([len(t) for t in texts]), 100)
    begins = np.cumsum([0] + [len(t) for t in texts])
    keys, data = {}, b"".join(texts)
    for k, d, s, n, one in zip(key, doc, start, windows, alone):
        own = [data[x:x + 100] for x in range(s, s + n)]
        assert s >= begins[d] and s + n + 99 <= begins[d + 1] and (not one or len(set(own)) == n)
        for w in own:
            assert keys.setdefault(w, k) == k
    assert windows.sum() == sum(max(0, len(t) - 99) for t in texts)
