import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from forecourt.llm import components, decontamination, simhash, toxicity

from . import brute
from .helpers import TEXTS, documents


def test_bit_sliced_links_equal_all_pairs():
    rng = np.random.default_rng(1)
    for radius in (1, 4, 6):
        for _ in range(60):
            n = int(rng.integers(1, 70))
            flips = [sum(1 << b for b in {int(x) for x in rng.integers(0, 64, int(rng.integers(0, radius + 2)))}) for _ in range(n)]
            values = np.array([(0x9E3779B97F4A7C15 if k % 3 else 0) ^ f for k, f in enumerate(flips)], np.uint64)
            bucket = np.sort(rng.integers(0, 4, n))
            label = simhash.link_rows(values, bucket[1:] == bucket[:-1], radius)
            for b in set(bucket.tolist()):
                rows = np.flatnonzero(bucket == b)
                want = brute.components([(int(r), int(values[r])) for r in rows], radius)
                assert [int(label[r]) for r in rows] == [want[k] for k in range(len(rows))]


@pytest.mark.parametrize("bucket", [3, 8192])
def test_near_duplicates_equal_brute_force(spark, bucket):
    random.seed(4)
    base = [" ".join(random.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(random.randint(0, 99)) for _ in range(200)) for _ in range(4)]
    rows = TEXTS + [(100 + i, t if i < 8 else t.replace("alpha", "Alpha").replace(f"beta{i}", "changed")) for i, t in enumerate(base * 12)]
    got = simhash.near_duplicates(documents(spark, rows), bucket=bucket).collect()
    prints = [(i, brute.simhash(t)) for i, t in rows]
    want = [(i, f, c) for (i, f), c in zip(prints, brute.components(prints))]
    assert sorted(map(str, want)) == sorted(str((r["key"], r["fingerprint"] & (1 << 64) - 1, r["component"])) for r in got)
    kept = simhash.keep_one_of_each(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert Counter(i for i in ids if i is not None) == Counter({c for _, _, c in want if c is not None})
    assert ids.count(None) == len({f for i, f, c in want if c is None})


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(1, 201)} | {i: 1000 for i in range(1001, 1050)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


ITEMS = [(1, "the quick brown fox jumps over the lazy dog again and again until night"), (2, "short item"), (3, ""), (4, None),
         (12, "a b a b a b a b a b a b a b"), (None, "nobody named this item at all today my friend ok yes"), (2, "short item"), (7, "É日本 ßx")]


@pytest.mark.parametrize("block_words", [1, 100_000])
def test_passages_equal_brute_force(spark, block_words):
    texts = ["The QUICK, brown fox jumps over the lazy dog -- again!", "fox jumps over the lazy dog again and again until x", "short", "short item short item",
             "x short\nitem y", "a b " * 9, "nobody named this item at all today my friend ok yes", "É日本 ßx É日本 ßx", "e日本 ßx", "short items"]
    rows = TEXTS + [(50 + i, t) for i, t in enumerate(texts)]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontamination.find_passages(documents(spark, rows), bench, block_words=block_words).collect()
    want = []
    for i, t in rows:
        n, hit, names = brute.passages(t, ITEMS)
        names = [x for x in names if x != "None"]
        want.append((i, n, hit, len(names), names, hit > 0))
    assert sorted(map(str, want)) == sorted(str((r["key"], r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"])) for r in got)
    clean = decontamination.clean_documents(documents(spark, rows), bench, block_words=block_words)
    assert clean.columns == documents(spark, []).columns and clean.count() == sum(not w[-1] for w in want)


def test_passages_of_nothing(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.find_passages(documents(spark, []), bench).count() == 0
    got = decontamination.find_passages(documents(spark), bench.limit(0)).agg(F.sum("n_hit"), F.count("*")).first()
    assert tuple(got) == (0, len(TEXTS))


def test_near_passages(spark):
    rows = [(1, "the quick brown foxes jumps over that lazy dog again and again"), (2, "the fox"), (3, "dog " * 50 + "quick fox"), (4, None)]
    bench = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    assert [tuple(r) for r in decontamination.find_near_passages(documents(spark, rows), bench, slop=3).select("key", "item").collect()] == [(1, "1")]


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, 600)
    grades = np.digitize(x + rng.normal(0, 0.4, 600), [1.5, 3.5, 4.5])
    weights, cuts = toxicity.fit_ordinal([np.array([0])] * 600, [np.array([float(v)]) for v in x], grades, 1, penalty=1e-6)
    assert weights[0] > 0 and (np.diff(cuts) > 0).all()
    expected = (1 / (1 + np.exp(cuts[None, :] - weights[0] * x[:, None]))).sum(axis=1)
    assert np.corrcoef(expected, grades)[0, 1] > 0.9


def test_toxicity_on_held_out_labels(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = toxicity.fit(docs, labels.where(~held))
    rows = toxicity.score(docs, model).select("row.doc_id", "toxic").join(labels.where(held).withColumnRenamed("toxic", "label"), "doc_id").collect()
    found = Counter((r["label"], r["toxic"]) for r in rows)
    assert found[0, True] <= 0.02 * (found[0, False] + found[0, True]) and found[1, True] >= 0.5 * (found[1, True] + found[1, False])


def test_toxicity_without_labels_or_texts(spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(documents(spark), labels)
    assert toxicity.score(documents(spark), model).agg(F.sum("severity"), F.count("*")).first() == (0.0, len(TEXTS))
    assert toxicity.score(documents(spark, []), model).count() == 0


def test_pipeline_equals_brute_force(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    model = toxicity.fit(read("documents"), read("labels"))
    rows = [(r["doc_id"], r["text"]) for r in read("documents").collect() if model.severity(r["text"] or "") < toxicity.TOXIC]
    rows = [(i, t) for i, t in rows if brute.good(t)]
    ids = brute.components([(i, brute.simhash(t)) for i, t in rows])
    items = [tuple(r) for r in read("benchmark").select("item_id", "text").collect()]
    rows = [(i, t) for (i, t), c in zip(rows, ids) if i == c and not brute.passages(t, items)[1]]
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = [(i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), brute.sha(pieces.decode(x))) for i, t in rows for x in [pieces.encode(t)]]
    assert sorted(map(tuple, got)) == sorted(want)
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_and_stand_awkward_rows(spark, sf_dir, stage):
    for rows in (TEXTS, []):
        out = corpus_pipeline.STAGES[stage][1](spark, documents(spark, rows), sf_dir)
        assert out.columns == documents(spark, []).columns and out.count() <= len(rows)


def test_encode_stage_stands_awkward_rows(spark, sf_dir):
    """The last stage returns rows of its own: one per document, nulls and empty texts too."""
    last = corpus_pipeline.STAGES[-1][1]
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {(r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in last(spark, documents(spark), sf_dir).collect()}
    assert got == {(i, len(pieces.encode(t or "")), brute.sha(pieces.decode(pieces.encode(t or "")))) for i, t in TEXTS}
    assert last(spark, documents(spark, []), sf_dir).count() == 0
