import gc
import hashlib
import random
import subprocess
import sys
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from forecourt.llm import merge_bpe, token_files

from .helpers import TEXTS, documents

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_merge_encoding_equals_library(model):
    own = merge_bpe.MergeEncoder(PIECES, cache=200)
    random.seed(1)
    letters = "abcdefghijklmnop eeetttaaonis  \n\téü日<>0xAF▁"
    texts = [t or "" for _, t in TEXTS] + ["▁a", "<s>", "<0x41>", " " * 100 + "x", "a" * 60, "\u200b é́ ﬁ", "a b"]
    texts += ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    for t in texts:
        assert own.encode(t).tolist() == model.encode(t), t


def test_compatibility_is_that_of_merging_the_pair(model):
    own = merge_bpe.MergeEncoder(PIECES)
    random.seed(2)
    usable = [i for i in own.id_of.values() if own.piece[i][0] != merge_bpe.MARK]
    for _ in range(3000):
        a, b = random.choice(usable), random.choice(usable)
        alone = own.history(a) is not None and own.history(b) is not None
        parts = [p for p in model.encode("\n" + own.piece[a] + own.piece[b])][2:]  # after the mark and the line end
        if alone:
            assert own.fits(a, b) == (parts == [a, b]), (own.piece[a], own.piece[b])


def test_round_trips(spark, model):
    got = merge_bpe.round_trips(documents(spark), PIECES).collect()
    want = []
    for i, t in TEXTS:
        ids = model.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((model.decode(ids) if ids else "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert merge_bpe.round_trips(documents(spark, []), PIECES).count() == 0


def test_encode_and_decode_columns(spark):
    rows = merge_bpe.decode_ids(merge_bpe.encode_texts(documents(spark), PIECES), PIECES).select("row.text", "decoded").collect()
    assert all((r["text"] or "") == r["decoded"] for r in rows)


def optimal_cost(counts):
    import heapq

    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        two = heapq.heappop(heap) + heapq.heappop(heap)
        cost += two
        heapq.heappush(heap, two)
    return cost


def test_code_lengths():
    rng = np.random.default_rng(0)
    for n in (2, 3, 17, 400):
        counts = rng.integers(1, 1000, n)
        lengths = token_files.code_lengths(counts, 20)
        assert (counts * lengths).sum() == optimal_cost(counts.tolist())
        short = token_files.code_lengths(counts, int(np.ceil(np.log2(n))) + 1)
        assert short.max() <= np.ceil(np.log2(n)) + 1 and (2.0 ** -short).sum() <= 1
    assert token_files.code_lengths(np.array([7]), 20).tolist() == [1]
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(9), 3)


def test_blocks_decode_on_their_own():
    rng = np.random.default_rng(1)
    counts = rng.zipf(1.2, 500) % 10**6 + 1
    symbols = np.sort(rng.choice(60_000, 500, replace=False))
    code = token_files.Code(symbols, token_files.code_lengths(counts, 12))
    for n in (1, 127, 128, 129, 5000):
        ids = rng.choice(symbols, n)
        payload, checkpoints = code.encode(ids, 128)
        assert len(checkpoints) == -(-n // 128) and (code.decode(payload, n, checkpoints, 128) == ids).all()


def test_crc_of_parts():
    data = bytes(range(256)) * 9
    for cut in (0, 1, 1000, len(data)):
        assert token_files.crc_of_parts([(zlib.crc32(data[:cut]), cut), (zlib.crc32(data[cut:]), len(data) - cut)]) == zlib.crc32(data)


def test_word_by_word_equals_whole_texts():
    own, whole = token_files.WordTokenizer(WORDS, cache=100), Tokenizer.from_file(WORDS)
    assert own.by_word
    random.seed(3)
    letters = "abcABCXYZÉé 's  \n\t.,.,!<|endoftext|>0123日ßÿµ²½ é ́\x1c ΣΑΣ' "
    texts = [t or "" for _, t in TEXTS] + ["it's. <|ENDOFTEXT|> <|endoftext|>", "a... b., c,. d.\x1c"]
    texts += ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    for t, packed in zip(texts, own.encode_all(texts)):
        assert np.frombuffer(packed, own.width).tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_new_words_are_encoded_many_at_once(monkeypatch):
    own, whole = token_files.WordTokenizer(WORDS), Tokenizer.from_file(WORDS)
    alone = []
    monkeypatch.setattr(own, "_pack", lambda texts, pack=own._pack: alone.extend(texts) or pack(texts))
    random.seed(4)
    words = ["".join(random.choices("abcdeéüµß", k=9)) + random.choice(["", ".", ",&&&", "'s", "''s!", "7²"]) for _ in range(3000)]
    texts = [" ".join(words[i:i + 7]) for i in range(0, len(words), 7)] + ["", " ", "日本 a<b <|endoftext|> x\xady"]
    for t, packed in zip(texts, own.encode_all(texts), strict=True):
        assert np.frombuffer(packed, own.width).tolist() == whole.encode(t, add_special_tokens=False).ids, t
    assert len(alone) <= 4


def test_table_of_pieces_takes_little_memory():
    """Known pieces are columns, not a Python object each, and their number is bounded by the cache and the texts at hand."""
    random.seed(5)
    words = list({"".join(random.choices("abcdefgh", k=8)) for _ in range(20_000)})
    texts = [" ".join(words[i:i + 100]) for i in range(0, len(words), 100)]
    own = token_files.WordTokenizer(WORDS, cache=30_000)
    want = own.encode_all(texts[:1])
    tracemalloc.start()
    own.encode_all(texts)
    gc.collect()
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 60 * len(words)
    own.encode_all([t[::-1] for t in texts])
    assert len(own.known) <= 30_000 and own.encode_all(texts[:1]) == want


def test_tasks_load_no_pandas():
    code = "import sys, forecourt.llm.token_files; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2]).returncode == 0


@pytest.mark.parametrize("block", [7, 100_000])
def test_files_read_back(spark, tmp_path, block):
    tokens = token_files.tokenize(documents(spark), WORDS, 2)
    tokens.write.parquet(str(tmp_path / "ids"))
    if block == 7:
        tokens = spark.read.parquet(str(tmp_path / "ids")).where("doc_id is null or doc_id <> 6" if "doc_id" in tokens.columns else "key is null or key <> 6")
    token_files.write_files(tokens, str(tmp_path / "out"), "<u2", block=block, every=3)
    got = sorted((tuple(r) for r in token_files.digest_files(spark, str(tmp_path / "out"), every=3).collect()), key=lambda r: r[1])
    whole = Tokenizer.from_file(WORDS)
    want = sorted((i is not None, i or 0, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)) for i, t in TEXTS if block > 7 or i != 6
                  for ids in [[*whole.encode(t or "", add_special_tokens=False).ids, 2]])
    assert sorted((k is not None, k or 0, crc, n) for k, _, n, crc in got) == want
    assert [k is not None and k or -1 for k, *_ in got] == sorted(k is not None and k or -1 for k, *_ in got)
    start = 0
    for _, s, n, _ in got:
        assert s == start
        start += n


def test_no_documents(spark):
    assert token_files.write_and_read(documents(spark, []), WORDS, 2).count() == 0
