"""Mixture-controlled packing: deficit round-robin over source queues fills every window to target token proportions.

Documents wait in one queue a source, in hash order. A round of the scheduler fills one window of ``window`` tokens, and
a window is one sequence. In each round every source earns its share of the window and is served the whole tokens of what
it has earned so far; the rest is its deficit, carried to the next round. Rounding goes down the list of sources in one
pass, so each round serves exactly ``window`` tokens and no source is ever a token away from what it has earned. Sources
that earn less than ``grain`` tokens a round share one queue of the scheduler: each of them saves its deficit up to a
grain and is then served it whole, in the order in which the grains fall due. A source that runs out leaves its share to
the others; only the last sequence is padded.

What is served by round k is a function of k and the sources' totals alone. So deficits need not be handed from window to
window or from task to task: each task works out where the tokens of its documents lie from their position in the queue,
which a distributed running total gives. Texts are tokenized once; the ids are written to the shared folder and moved once.

Ids are those of the tokenizers library for the given file. They are computed by tiktoken from the ranks of the same
vocabulary, which is several times faster; texts with the special token's string go through tokenizers itself.

Defined results: a null or empty text is the end token alone; a null source is a source of its own; repeated rows are
packed each; an empty table gives no pieces; other columns of the input are left behind. The schedule has some numbers a
source, and grains of small sources are compared with all other small sources: it is made for up to some thousands of
sources.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import map_arrow, materialize, null_safe, running_total

WINDOW = 1024
GRAIN = 16
END_ID = 0
SPECIAL = "<|endoftext|>"
#: Cells of the (grain, small source) table evaluated at once.
CELLS = 2_000_000


@lru_cache(maxsize=2)
def _encoders(json_path: str, ranks_path: str, pattern: str):
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return fast, Tokenizer.from_file(json_path)


def token_ids(text: str, json_path: str, ranks_path: str, pattern: str) -> np.ndarray:
    fast, exact = _encoders(json_path, ranks_path, pattern)
    if SPECIAL in text:
        return np.array(exact.encode(text, add_special_tokens=False).ids, "<u4")
    return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")


def tokenize(docs: DataFrame, tokenizer: tuple[str, str, str], key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """_row, the key, _s (the source, null-safe), n_tokens and ids, the end token last.

    Ids are little-endian, two bytes each where the largest is below 65536, else four: they are stored and moved once.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), null_safe(source).alias("_s"), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.append(token_ids(t or "", *tokenizer), np.uint32(END_ID)) for t in b.column(3).to_pylist()]
            counts = pa.array([len(x) for x in ids], pa.int64())
            ids = [x.astype("<u2" if x.max() < 1 << 16 else "<u4").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], counts, pa.array(ids, pa.binary())], ["_row", "_key", "_s", "n_tokens", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(rows, run, f"_row bigint, _key {kind}, _s string, n_tokens bigint, ids binary")


def water_fill(left: np.ndarray, weights: np.ndarray, window: int) -> np.ndarray:
    """Whole tokens of one round: the window by weight, no source above what it has left, the excess shared again."""
    quota, open_ = np.zeros(len(left)), left > 0
    room = float(min(window, left.sum()))
    while open_.any() and room > 1e-9:
        step = room * weights / weights[open_].sum()
        full = open_ & (left - quota <= step * (1 + 1e-12))
        if not full.any():
            quota[open_] += step[open_]
            break
        room -= (left - quota)[full].sum()
        quota[full] = left[full]
        open_ &= ~full
    out = np.minimum(np.floor(quota + 1e-9).astype(np.int64), left)
    rest = int(min(window, left.sum()) - out.sum())
    order = np.argsort(-(quota - out), kind="stable")
    while rest > 0:
        for i in order:
            if rest and out[i] < left[i]:
                out[i] += 1
                rest -= 1
    return out


class Schedule:
    """Where the tokens of each source's queue lie in the stream of windows."""

    def __init__(self, totals: list[int], weights: list[float], window: int, grain: int):
        t, w = np.array(totals, np.int64), np.array(weights, np.float64)
        self.window, self.grain, self.total = window, grain, t
        self.share = np.maximum(w / max(w.sum(), 1e-300), 1e-15)
        # sources below a grain a round share a queue; others join until it earns a grain a round
        order = np.argsort(self.share, kind="stable")
        n = int((self.share * window < grain).sum())
        while 0 < n < len(t) and self.share[order[:n]].sum() * window < grain:
            n += 1
        self.small = np.sort(order[:n])
        self.lane = np.zeros(len(t), np.int64)  # a source's queue of the scheduler; the shared one is the last
        large = np.setdiff1d(np.arange(len(t)), self.small)
        self.lane[large] = np.arange(len(large))
        self.lane[self.small] = len(large)
        lanes = [*((int(t[i]), w[i]) for i in large), *([(int(t[self.small].sum()), w[self.small].sum())] if n else [])]
        self._phases(np.array([x for x, _ in lanes], np.int64), np.array([x for _, x in lanes]))
        #: Small sources start with different parts of a grain saved, so that their grains do not fall due together.
        self.phase = np.mod(np.arange(1, n + 1) * 0.6180339887498949, 1.0)

    def _phases(self, left: np.ndarray, w: np.ndarray) -> None:
        """Runs of rounds with constant rates: the first round, tokens served before (summed over lanes), cumulative rates."""
        first, base, rates, k, total = [], [], [], 0, left.copy()
        while left.sum() > 0:
            open_ = left > 0
            c = np.cumsum(np.where(open_, w, 0.0)) * (self.window / w[open_].sum())
            c[np.flatnonzero(open_)[-1] :] = self.window
            rate = np.diff(c, prepend=0.0)
            # a token of slack for the rounding: nobody is served more than it has left
            rounds = int(np.floor((left[open_] - 2) / np.maximum(rate[open_], 1e-300)).min())
            first.append(k)
            base.append(np.cumsum(total - left))
            if rounds > 0:
                rates.append(c)
                left = left - np.diff(np.floor(rounds * c), prepend=0.0).astype(np.int64)
            else:
                rounds = 1
                rates.append(np.zeros(len(w)))
                left = left - water_fill(left, w, self.window)
            k += rounds
        self.rounds = k
        self.first = np.array([*first, k], np.int64)
        self.base = np.array([*base, np.cumsum(total)], np.int64).reshape(len(first) + 1, len(total))
        self.rates = np.array([*rates, np.zeros(len(total))]).reshape(len(first) + 1, len(total))

    def upto(self, lane: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Tokens that the lanes up to and with this one have been served before round k; lane -1: none."""
        j = np.searchsorted(self.first, k, "right") - 1
        at = np.maximum(lane, 0)
        return np.where(lane < 0, 0, self.base[j, at] + np.floor((k - self.first[j]) * self.rates[j, at]).astype(np.int64))

    def served(self, lane: np.ndarray, k: np.ndarray) -> np.ndarray:
        return self.upto(lane, k) - self.upto(lane - 1, k)

    def round_of(self, lane: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The round that serves token p of a lane: the first k with served(k) <= p < served(k + 1)."""
        low, high = np.zeros(len(p), np.int64), np.full(len(p), max(self.rounds - 1, 0), np.int64)
        while (low < high).any():
            mid = (low + high) // 2
            past = self.served(lane, mid + 1) > p
            high, low = np.where(past, mid, high), np.where(past, low, np.minimum(mid + 1, high))
        return low

    def _due(self, i: np.ndarray, m: np.ndarray) -> np.ndarray:
        """When grain m of small source i falls due, in tokens of the shared queue's weight."""
        return (m + self.phase[i]) * (self.grain / self.share[self.small[i]])

    def grain_starts(self, i: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Where grain m of small source i lies in the shared queue: the tokens of all grains due before it."""
        out, totals = m * self.grain, self.total[self.small]
        step = max(1, CELLS // max(1, len(totals)))
        for a in range(0, len(m), step):
            due, mine = self._due(i[a : a + step], m[a : a + step])[:, None], i[a : a + step][:, None]
            s = np.broadcast_to(np.arange(len(totals)), (len(due), len(totals)))
            n = np.maximum(np.floor(due * self.share[self.small] / self.grain - self.phase).astype(np.int64), 0)
            # the estimate is put right by the very times that are compared: all tasks agree
            earlier = lambda x: (self._due(s, x) < due) | ((self._due(s, x) == due) & (s < mine))  # noqa: B023, E731
            for _ in range(3):
                n = np.where(earlier(n), n + 1, n)
                n = np.where((n > 0) & ~earlier(n - 1), n - 1, n)
            tokens = np.minimum(n * self.grain, totals)
            tokens[s == mine] = 0
            out[a : a + step] += tokens.sum(1)
        return out

    def places(self, s: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of documents (source, place in its queue, tokens): document, start in it, length, sequence, offset."""
        doc, lane, at, lo, n = np.arange(len(s)), self.lane[s], np.zeros(len(s), np.int64), start, n
        shared = np.isin(s, self.small)
        if shared.any():
            g, d = self.grain, doc[shared]
            m0, m1 = start[d] // g, (start[d] + n[d] - 1) // g
            of = np.repeat(d, m1 - m0 + 1)
            m = np.arange(len(of)) - np.repeat(np.cumsum(m1 - m0 + 1) - (m1 - m0 + 1), m1 - m0 + 1) + np.repeat(m0, m1 - m0 + 1)
            begin, end = np.maximum(m * g, start[of]), np.minimum((m + 1) * g, (start + n)[of])
            place = self.grain_starts(np.searchsorted(self.small, s[of]), m) + begin - m * g
            # grains that follow each other in the shared queue are one stretch
            head = np.ones(len(of), bool)
            head[1:] = (of[1:] != of[:-1]) | (place[1:] != place[:-1] + (end - begin)[:-1])
            h = np.flatnonzero(head)
            size = np.add.reduceat(end - begin, h) if len(h) else np.zeros(0, np.int64)
            doc, lane, at, lo, n = (np.concatenate([x[~shared], y]) for x, y in ((doc, of[h]), (lane, lane[of[h]]), (at, (begin - start[of])[h]), (lo, place[h]), (n, size)))
        k0, k1 = self.round_of(lane, lo), self.round_of(lane, lo + n - 1)
        count = k1 - k0 + 1
        i = np.repeat(np.arange(len(doc)), count)
        k = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + k0[i]
        before, mine = self.upto(lane[i] - 1, k), self.served(lane[i], k)
        begin = np.maximum(mine, lo[i])
        end = np.minimum(self.served(lane[i], k + 1), (lo + n)[i])
        # a round's tokens lie in the order of the lanes
        offset = self.upto(lane[i] - 1, k + 1) - before + begin - mine
        real = np.flatnonzero(end > begin)
        i, k, begin, end, offset = i[real], k[real], begin[real], end[real], offset[real]
        return doc[i], at[i] + begin - lo[i], end - begin, k, offset


def pack(docs: DataFrame, tokenizer: tuple[str, str, str], window: int = WINDOW, grain: int = GRAIN, weights: dict[str | None, float] | None = None, with_ids: bool = True, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row a piece: key, start, length, ids_crc32, doc_tokens, sequence_id (the round), offset, its source, the
    source's deficit (tokens it has earned by its target share up to and with the window, less those served up to and with
    the piece), queue_start (where the document begins in its source's queue, which tells copies of a row apart), and the
    ids if wanted.

    tokenizer: the paths of the tokenizers file and of its ranks, and the pattern of the latter. weights: target
    proportion of each source (others: 0.001); by default the sources' own, so that all queues last to the end. The
    sources' totals (one row a source, not a document) are the only thing the driver sees.
    """
    tokens = materialize(tokenize(docs, tokenizer, key, text, source), "pack-tokens")
    totals = {r._s: r.n for r in tokens.groupBy("_s").agg(F.sum("n_tokens").alias("n")).collect()}
    names = sorted(totals)
    share = {None: "0"} | {x: f"1{x}" for x in weights or () if x is not None}
    wanted = {share[x]: float(w) for x, w in (weights or {}).items()}
    schedule = Schedule([totals[s] for s in names], [wanted.get(s, 1e-3) if weights else float(totals[s]) for s in names], window, grain)
    index, labels = {s: i for i, s in enumerate(names)}, [None if s == "0" else s[1:] for s in names]
    queued = running_total(tokens.withColumn("_h", F.xxhash64(F.lit("pack"), "_row", "_key")), ["_s"], "_h", ["_row"], F.col("n_tokens"), "_start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = np.array([index[x] for x in b.column(1).to_pylist()], np.int64)
            start, n = b.column(2).to_numpy(), b.column(3).to_numpy()
            doc, at, length, seq, offset = schedule.places(s, start, n)
            deficit = schedule.share[s[doc]] * window * (seq + 1) - (start[doc] + at + length)
            ids = [memoryview(np.frombuffer(x, f"<u{len(x) // m}").astype("<u4").tobytes()) for x, m in zip(b.column(4).to_pylist(), n.tolist(), strict=True)]
            cuts = [ids[d][4 * a : 4 * (a + m)] for d, a, m in zip(doc.tolist(), at.tolist(), length.tolist(), strict=True)]
            columns = [b.column(0).take(pa.array(doc)), pa.array(at), pa.array(length), pa.array([zlib.crc32(c) for c in cuts], pa.int64()), pa.array(n[doc]), pa.array(seq), pa.array(offset), pa.array([labels[x] for x in s[doc].tolist()], pa.string()), pa.array(deficit), pa.array(start[doc])]
            if with_ids:
                values = np.frombuffer(b"".join(cuts), "<u4").astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(values)))
            yield pa.RecordBatch.from_arrays(columns, names_out)

    names_out = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "deficit", "queue_start"] + ["ids"] * with_ids
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string, deficit double, queue_start bigint" + ", ids array<int>" * with_ids
    pieces = map_arrow(queued.select("_key", "_s", "_start", "n_tokens", "ids"), run, schema)
    return pieces.withColumnRenamed("key", key)
