"""The registered corpus queries on the smallest tables, against other ways to the same result."""

import base64
import os

import duckdb
import pytest

tiktoken = pytest.importorskip("tiktoken")

from gridloom.llm import tokenizer  # noqa: E402
from gridloom.llm.queries import QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"select * from read_parquet('{DATA}/documents.parquet')").fetchdf().set_index("doc_id")


@pytest.fixture(scope="module")
def ids(spark):
    return {r.doc_id: list(r.ids) for r in QUERIES["p6_ids"](spark, DATA).collect()}


def test_ids(documents, ids):
    with open(tokenizer.DEFAULT_RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("p", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert ids == {i: encoding.encode_ordinary(t) if isinstance(t, str) else [] for i, t in documents["text"].items()}


def test_mixture(spark, documents, ids):
    target = {r.source: r for r in spark.read.parquet(f"{DATA}/mix_target.parquet").collect()}
    have = {s: sum(len(ids[i]) for i in documents.index[documents["source"] == s]) for s in target}
    total = sum(map(len, ids.values()))
    short = {s for s, r in target.items() if have[s] * r.max_repeats < r.target_share * total}
    assert {r.source for r in QUERIES["p7_found"](spark, DATA).collect()} == short
    sample = QUERIES["p7_sample"](spark, DATA).collect()
    assert len({r.doc_id for r in sample}) == len(sample) and all(0 < r.copies <= target[r.source].max_repeats for r in sample)
    shares = {r.source: r for r in QUERIES["p7_shares"](spark, DATA).collect()}
    assert set(shares) == set(target)
    for s, r in shares.items():
        assert r.used_tokens == sum(len(ids[x.doc_id]) * x.copies for x in sample if x.source == s)


def test_cut_texts(spark, documents):
    found = {r.doc_id for r in QUERIES["p8_found"](spark, DATA).collect()}
    rates = {r.source: (r.n_docs, r.n_cut) for r in QUERIES["p8_rates"](spark, DATA).collect()}
    assert sum(n for n, _ in rates.values()) == len(documents) and sum(n for _, n in rates.values()) == len(found)
    blank = {i for i, t in documents["text"].items() if not isinstance(t, str) or not t.strip()}
    assert not found & blank
