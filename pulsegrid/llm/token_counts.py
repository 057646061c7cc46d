"""Token counts by rank-synchronous array merging, for byte-pair models of the sentencepiece library.

Texts are normalised by the library and cut into pre-tokens where no piece of the model can reach across: at space marks,
and between two characters that stand side by side in no piece. The distinct
pre-tokens of a batch lie one after the other in ragged numpy arrays: symbols, the rank of each symbol joined with the
next, and where each sequence starts. In every round all sequences apply their lowest-rank pair (the leftmost of equal
ones, as the library does) at once; sequences without a pair leave. What survives is counted: a symbol of the
vocabulary is one token, an unknown character as many as it has bytes. Counts of short pre-tokens are kept between batches.

A round costs as much as its arrays are long, so a sequence of more than ``LONG`` symbols (a text without spaces, say)
would cost their square. Such a sequence is merged by itself, in the same order, from a heap of its pairs: n log n steps.

Defined results: null and empty texts have 0 bytes and 0 tokens; special strings in a text are ordinary text, as in
the library; repeated rows are counted each; an empty table gives an empty result; other input columns are left behind.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pulsegrid.llm.common import map_arrow

SPACE = "▁"
#: Pre-tokens whose counts a worker keeps.
CACHE = 400_000
#: Pre-tokens merged at once; characters of one whose count is kept.
CHUNK = 50_000
KEPT = 64
#: Symbols of a sequence that is merged with the others.
LONG = 256
_RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NONE = np.iinfo(np.int64).max


class MergeTable:
    """Symbols and pair ranks of a model, as sorted arrays."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        special = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)
        pieces = {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not special(i)}
        #: No piece has a space after anything else: then a space always starts a pre-token.
        self.splits = " " not in m.normalize("a b") and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        known = list(pieces)
        ids = {p: i for i, p in enumerate(known)}
        for c in sorted({c for p in pieces for c in p} - ids.keys()):
            ids[c] = len(ids)
        self.n_symbols = len(ids)
        self.cost = np.ones(len(ids), np.int64)  # tokens of a symbol that survives
        for s, i in ids.items():
            if s not in pieces:
                self.cost[i] = len(s.encode())
        ranks = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        pairs = [(ids[p[:k]] * len(ids) + ids[p[k:]], ranks[pieces[p]], ids[p]) for p in known for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        pairs.sort()
        self.keys, self.ranks, self.merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        chars = sorted((ord(s), i) for s, i in ids.items() if len(s) == 1)
        self.points, self.point_ids = (np.array(x, np.int64) for x in zip(*chars, strict=True))
        place = {chr(c): i for i, (c, _) in enumerate(chars)}
        #: Characters that stand side by side in some piece.
        self.bigrams = np.array(sorted({place[a] * len(chars) + place[b] for p in pieces for a, b in zip(p, p[1:], strict=False)}), np.int64)
        self.of_pair = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True))

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; rank NONE where the pair has no merge."""
        key = np.where((left < self.n_symbols) & (right < self.n_symbols), left * self.n_symbols + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def costs(self, sym: np.ndarray) -> np.ndarray:
        """Tokens of each symbol that survives."""
        return np.where(sym < self.n_symbols, self.cost[np.minimum(sym, self.n_symbols - 1)], sym - self.n_symbols)

    def count(self, sequences: list[str]) -> np.ndarray:
        """Tokens of each (non-empty) sequence."""
        points = np.frombuffer("".join(sequences).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        known = self.points[at] == points
        # an unknown character becomes a symbol above all others that carries its number of bytes
        n_bytes = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        sym = np.where(known, self.point_ids[at], self.n_symbols + n_bytes)
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        last = np.zeros(len(sym), bool)
        last[np.cumsum(lengths) - 1] = True
        owner = np.repeat(np.arange(len(sequences)), lengths)
        key = np.where(known & np.roll(known, -1), at * len(self.points) + np.roll(at, -1), -1)
        near = self.bigrams[np.minimum(np.searchsorted(self.bigrams, key), len(self.bigrams) - 1)] == key
        last |= ~near
        starts = np.flatnonzero(np.concatenate([[True], last[:-1]]))
        owner, lengths = owner[starts], np.diff(np.append(starts, len(sym)))
        out = np.zeros(len(sequences), np.int64)
        alone = lengths == 1
        far = lengths > LONG
        for i in np.flatnonzero(far):
            out[owner[i]] += self._merge_one(sym[starts[i] : starts[i] + lengths[i]])
        np.add.at(out, owner[alone], self.costs(sym[starts[alone]]))
        rest = ~(alone | far)
        if rest.any():
            inside = np.repeat(rest, lengths)
            np.add.at(out, owner[rest], self._merge_all(sym[inside], last[inside], lengths[rest]))
        return out

    def _merge_one(self, sym: np.ndarray) -> int:
        """Tokens of one long sequence."""
        n, size, of_pair = len(sym), self.n_symbols, self.of_pair
        rank, _ = self.rank(sym[:-1], sym[1:])
        some = np.flatnonzero(rank != NONE)
        heap = list(zip((rank[some] * n + some).tolist(), (sym[some] * size + sym[some + 1]).tolist(), strict=True))
        heapq.heapify(heap)
        s, after, before = sym.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            place, key = heapq.heappop(heap)
            i = place % n
            j = after[i]
            if s[i] < 0 or j >= n or s[i] * size + s[j] != key:
                continue  # one of the two has been merged
            s[i], s[j], after[i] = of_pair[key][1], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and s[a] < size and s[b] < size and (hit := of_pair.get(s[a] * size + s[b])):
                    heapq.heappush(heap, (hit[0] * n + a, s[a] * size + s[b]))
        left = np.array(s, np.int64)
        return int(self.costs(left[left >= 0]).sum())

    def _merge_all(self, sym: np.ndarray, last: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each sequence, all merged at once; ``last`` marks the last symbol of each."""
        out, owner, starts = np.zeros(len(lengths), np.int64), np.arange(len(lengths)), np.cumsum(lengths) - lengths
        rank, merged = self._adjacent(sym, last)
        while len(owner):
            order = np.where(rank == NONE, NONE, rank * len(sym) + np.arange(len(sym)))
            best = np.minimum.reduceat(order, starts)
            done = best == NONE
            if done.any():
                gone = np.repeat(done, lengths)
                sums = np.add.reduceat(self.costs(sym), starts)
                out[owner[done]] = sums[done]
                sym, rank, merged, last = (x[~gone] for x in (sym, rank, merged, last))
                owner, lengths = owner[~done], lengths[~done]
                if not len(owner):
                    break
                before = np.cumsum(gone) - gone  # symbols gone before each
                best = best[~done] % len(gone)
                p = best - before[best]
            else:
                p = best % len(sym)
            sym[p] = merged[p]
            last[p] = last[p + 1]
            keep = np.ones(len(sym), bool)
            keep[p + 1] = False
            sym, rank, merged, last = (x[keep] for x in (sym, rank, merged, last))
            lengths = lengths - 1
            starts = np.cumsum(lengths) - lengths
            p = p - np.arange(len(p))  # one symbol went from each sequence before
            for q in (p, p[p > starts] - 1):
                r, m = self.rank(sym[q], sym[np.minimum(q + 1, len(sym) - 1)])
                rank[q], merged[q] = np.where(last[q], NONE, r), m
        return out

    def _adjacent(self, sym: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, merged = self.rank(sym, np.roll(sym, -1))
        return np.where(last, NONE, rank), merged


_cache: dict[str, dict[str, int]] = {}


@lru_cache(maxsize=4)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def pretokens(normal: str, splits: bool) -> list[str]:
    """The pre-tokens of a normalised text, each without its first space mark; a blank, which normalised texts lack, marks one without."""
    if not splits:
        return [normal]
    if normal[:1] == SPACE and normal[-1:] != SPACE and SPACE + SPACE not in normal:
        return normal[1:].split(SPACE)
    return [x[1:] if x[0] == SPACE else " " + x for x in _RUNS.findall(normal)]


def count_tokens(texts: list[str], path: str) -> list[int]:
    table, cache = merge_table(path), _cache.setdefault(path, {})
    words = [pretokens(x, table.splits) if x else [] for x in table.model.normalize(texts)] if texts else []
    if len(cache) > CACHE:
        cache.clear()
    missing = list({w for ws in words for w in ws} - cache.keys())
    whole = (lambda w: w[1:] if w[:1] == " " else SPACE + w) if table.splits else (lambda w: w)
    long = {}
    for i in range(0, len(missing), CHUNK):
        part = missing[i : i + CHUNK]
        for w, n in zip(part, table.count([whole(w) for w in part]).tolist(), strict=True):
            (cache if len(w) <= KEPT else long)[w] = n
    return [sum(long[w] if len(w) > KEPT else cache[w] for w in ws) for ws in words] if long else [sum(map(cache.__getitem__, ws)) for ws in words]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_bytes, n_tokens and whether there are more than ``limit``."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            n = count_tokens(texts, model_path)
            sizes = [len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["key", "n_bytes", "n_tokens", "over_limit"])

    out = map_arrow(docs.select(key, text), run, f"key {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("key", key)
