import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridloom.llm import tokenizer

pytestmark = pytest.mark.skipif(not os.path.exists(tokenizer.DEFAULT_RANKS), reason="no vocabulary here")


@pytest.fixture(scope="module")
def both():
    import tiktoken

    ranks = tokenizer.load_ranks(tokenizer.DEFAULT_RANKS)
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tokenizer.SpeculativeEncoder(ranks), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(9)
    alphabet = "abc 'sré中文日本\n\t  12٣½🙂​́\x00\x1f�ЖæÅ"
    out = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(80))) for _ in range(1500)]
    out += [f"a{chr(c)}b {chr(c)}1{chr(c)}{chr(c)}\n{chr(c)} " for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    return [*out, "", "   ", "<|endoftext|>", "don't we'll", "a" * 30_000, " " * 5000, "ab" * 9000, "中" * 5000]


def test_equals_a_reference_encoder(both):
    enc, reference = both
    sample = texts()
    assert enc.encode_batch(sample) == [reference.encode_ordinary(t) for t in sample]
    assert 0 < enc.stats["merged"] < enc.stats["words"]


def test_greedy_is_not_enough(both):
    """Speculation is verified: some words' greedy split differs from the merges, and those are caught."""
    enc, reference = both
    words = [w for w in {w for t in texts() for w in enc._words.findall(t)} if len(w) < 40]
    different = [w for w in words if enc.greedy(w.encode()) != enc.merge(w.encode())]
    assert different
    fresh = tokenizer.SpeculativeEncoder(enc.ranks)
    assert fresh.encode_words(different) == [tuple(reference.encode_ordinary(w)) for w in different]


def test_round_trip(both):
    enc, _ = both
    for t in texts()[:300]:
        assert b"".join(enc.tokens[i] for i in enc.encode_batch([t])[0]).decode() == t


def test_documents(spark, both):
    data = [(1, "a b", "x"), (2, None, "y"), (3, "", None), (3, "a b", "again"), (4, "long " * 50_000, "z"), (None, "q", "z")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids string")  # a clashing column
    got = sorted(tokenizer.encode(df, "doc_id", "text", max_batch_chars=1000).collect(), key=repr)
    _, reference = both
    want = sorted(((d, reference.encode_ordinary(t or "")) for d, t, _ in data), key=lambda x: repr(x[0]) + repr(x[1]))
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=lambda x: repr(x[0]) + repr(x[1])) == want
    assert tokenizer.encode(df.limit(0), "doc_id", "text").count() == 0
    counts = tokenizer.count_tokens(df, "text", keep=("doc_id", "ids")).where("ids = 'z'").collect()
    assert sorted(r.n_tokens for r in counts) == [1, len(reference.encode_ordinary("long " * 50_000))]


def test_cache_is_bounded(both, monkeypatch):
    monkeypatch.setattr(tokenizer, "CACHE_WORDS", 50)
    enc = tokenizer.SpeculativeEncoder(both[0].ranks)
    sample = [f"word{i} thing{i}" for i in range(200)]
    for t in sample:
        assert enc.encode_batch([t]) == [both[1].encode_ordinary(t)]
    assert len(enc._cache) <= 60
