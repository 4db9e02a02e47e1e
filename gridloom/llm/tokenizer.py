"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 6), speculatively.

A sequence of tokens is the merge result of its bytes exactly if every token is the merge result of its own bytes and
every adjacent pair is *compatible*: merging the two tokens' bytes gives back the two tokens. So

1. words (by the vocabulary's split pattern) that are tokens are done;
2. for other distinct words greedy longest match proposes tokens;
3. the adjacent pairs of all proposals of a batch are looked up at once in a sorted table of pairs already judged
   (vectorised); pairs seen for the first time are judged once by merging their few bytes;
4. only words with an incompatible pair are merged exactly, in O(n log n).

Distinct words are encoded once per task and kept in a bounded cache; documents never leave their partition, so there
is no shuffle and no skew by language or source.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits text before the merges of the rank files. White space is spelled out, as the
#: engines differ in what \s means.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE_WORDS = 400_000
CACHED_BYTES = 64  # longer words are not kept


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class SpeculativeEncoder:
    """Greedy proposals, verified pairwise; see the module's text. Counts of what happened are in ``stats``."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.size = max(self.tokens) + 1
        self._words = regex.compile(PATTERN)
        self._cache: dict[str, tuple[int, ...]] = {}
        # judged pairs as sorted keys a * size + b, and their verdicts
        self._keys = np.empty(0, np.int64)
        self._good = np.empty(0, bool)
        self.stats = {"words": 0, "whole": 0, "proposed": 0, "merged": 0, "pairs": 0}

    def greedy(self, word: bytes) -> list[int]:
        ranks, out, at, n = self.ranks, [], 0, len(word)
        while at < n:
            end = min(n, at + self.longest)
            while word[at:end] not in ranks:
                end -= 1
            out.append(ranks[word[at:end]])
            at = end
        return out

    def merge(self, word: bytes) -> list[int]:
        """The exact merges: always the pair of lowest rank, the leftmost of equal ones."""
        ranks, n = self.ranks, len(word)
        if n < 2:
            return [ranks[word]] if n else []
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        end = list(range(1, n + 1))  # part i is word[i:end[i]]
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or end[j] != stop or not alive[j]:
                continue
            end[i], right[i], alive[j] = stop, right[j], False
            if right[j] < n:
                left[right[j]] = i
                k = right[i]
                if (r := ranks.get(word[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if left[i] >= 0:
                h = left[i]
                if (r := ranks.get(word[h:stop])) is not None:
                    heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = right[i]
        return out

    def _verify(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Compatibility of pairs of tokens; judges the pairs not met before."""
        keys = first.astype(np.int64) * self.size + second
        distinct = np.unique(keys)
        place = np.searchsorted(self._keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self._keys)
        known[inside] = self._keys[place[inside]] == distinct[inside]
        new = distinct[~known]
        if len(new):
            self.stats["pairs"] += len(new)
            good = np.fromiter((self._compatible(int(k) // self.size, int(k) % self.size) for k in new), bool, len(new))
            if len(self._keys) > 4_000_000:
                self._keys, self._good = np.empty(0, np.int64), np.empty(0, bool)
                return self._verify(first, second)
            at = np.searchsorted(self._keys, new)
            self._keys, self._good = np.insert(self._keys, at, new), np.insert(self._good, at, good)
        return self._good[np.searchsorted(self._keys, keys)]

    def _compatible(self, a: int, b: int) -> bool:
        return self.merge(self.tokens[a] + self.tokens[b]) == [a, b]

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Token ids of distinct words."""
        out: list[tuple[int, ...] | None] = [None] * len(words)
        open_words, raw, proposals = [], [], []
        self.stats["words"] += len(words)
        for i, w in enumerate(words):
            b = w.encode("utf-8", "replace")
            rank = self.ranks.get(b)
            if rank is not None:
                out[i] = (rank,)
                self.stats["whole"] += 1
                continue
            open_words.append(i)
            raw.append(b)
            proposals.append(self.greedy(b))
        if open_words:
            self.stats["proposed"] += len(open_words)
            lengths = np.fromiter(map(len, proposals), np.int64, len(proposals))
            flat = np.fromiter((t for p in proposals for t in p), np.int64, int(lengths.sum()))
            owner = np.repeat(np.arange(len(proposals)), lengths)
            pair = np.flatnonzero(owner[:-1] == owner[1:])
            bad = np.zeros(len(proposals), bool)
            if len(pair):
                good = self._verify(flat[pair], flat[pair + 1])
                bad[owner[pair[~good]]] = True
            for k, i in enumerate(open_words):
                if bad[k]:
                    self.stats["merged"] += 1
                    out[i] = tuple(self.merge(raw[k]))
                else:
                    out[i] = tuple(proposals[k])
        return out

    def encode_batch(self, texts: Iterable[str | None]) -> list[list[int]]:
        """Ids of each text; an empty list for a null or empty one."""
        texts = list(texts)
        split = [self._words.findall(t) if t else [] for t in texts]
        cache = self._cache
        new = list({w for ws in split for w in ws if w not in cache})
        fresh = dict(zip(new, self.encode_words(new), strict=True))
        out = []
        for ws in split:
            ids: list[int] = []
            for w in ws:
                got = cache.get(w)
                ids.extend(fresh[w] if got is None else got)
            out.append(ids)
        if len(cache) + len(fresh) > CACHE_WORDS:
            cache.clear()
        cache.update((w, v) for w, v in fresh.items() if len(w) <= CACHED_BYTES)
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> SpeculativeEncoder:
    """One encoder per Python worker and vocabulary."""
    return SpeculativeEncoder(load_ranks(path))


def encode(df: DataFrame, id_column: str, text_column: str, ranks_path: str = DEFAULT_RANKS, max_batch_chars: int = 4_000_000) -> DataFrame:
    """``doc_id, ids``: the token ids of every row's text, one row per input row.

    Null, empty: an empty list. Blank texts, controls, mixed scripts and damaged characters are encoded as they are; lone
    surrogates, which UTF-8 cannot hold, as ``?``. Texts of any length are encoded whole. Repeated ids stay repeated rows. Other columns, clashing
    names included, are ignored. The vocabulary's path must be readable on every executor.
    """
    kind = df.schema[id_column].dataType.simpleString()
    picked = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for batch in batches:
            for piece in _pieces(batch, max_batch_chars):
                ids = enc.encode_batch(piece.column(1).to_pylist())
                lengths = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((t for x in ids for t in x), np.int32, int(lengths.sum()))
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return picked.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def count_tokens(df: DataFrame, text_column: str, ranks_path: str = DEFAULT_RANKS, keep: Iterable[str] = (), max_batch_chars: int = 4_000_000) -> DataFrame:
    """``keep..., n_tokens`` of every row; 0 for a null or empty text. The texts and ids never leave the task."""
    kept = list(keep)
    picked = df.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(kept)], F.col(text_column).cast("string").alias("__text"))
    types = [f"`__k{i}` {df.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for batch in batches:
            for piece in _pieces(batch, max_batch_chars):
                ids = enc.encode_batch(piece.column(len(kept)).to_pylist())
                yield pa.RecordBatch.from_arrays([*[piece.column(i) for i in range(len(kept))], pa.array([len(x) for x in ids], pa.int64())], names=[*[f"__k{i}" for i in range(len(kept))], "n_tokens"])

    return picked.mapInArrow(run, ", ".join([*types, "n_tokens bigint"])).withColumnsRenamed({f"__k{i}": c for i, c in enumerate(kept)})


def _pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of text each (a longer single text is its own slice)."""
    column = batch.column(batch.num_columns - 1)
    if column.nbytes <= most or batch.num_rows <= 1:
        yield batch
        return
    half = batch.num_rows // 2
    yield from _pieces(batch.slice(0, half), most)
    yield from _pieces(batch.slice(half), most)
