"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A text is cut into passages of 64 words. Each is encoded by a layer over its features: frequencies of pairs of byte
classes (capitals, symbols, marks ...), and how much of it repeats earlier words, word pairs and word triples of the
text. Gated attention, softmax over w . (tanh(V h) * sigmoid(U h)), weighs the encoded passages; the weighted sum
stands for the document, and its label alone teaches encoder, attention and output together.

The classifier is fitted in numpy on a bounded sample of the labelled rows: at most ``FIT_DOCUMENTS`` documents, the
first in hash order. Where they have more than ``FIT_PASSAGES`` passages, the longest of them are fitted on means of
neighbouring passages, so many that all documents fit and every word still counts; how long the others are does not
matter. Only if more rows than ``FIT_PASSAGES`` share the sampled keys are some left out, the last in hash order.
Scoring runs over whole texts in Arrow batches.

Defined results: a null or empty text has one passage without words; labelled rows with a null label or key teach
nothing; if all labels are alike or there are none, every score is their mean (0.5 without any); repeated rows are
scored each; an empty table gives an empty result; other columns of the input are left behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import WORD, forget, map_arrow, materialize

PASSAGE = 64
FIT_DOCUMENTS = 4000
FIT_PASSAGES = 80_000
THRESHOLD = 0.7
#: Bytes of text whose arrays are held at once, one text at least.
CHUNK = 1 << 20
#: Bytes of a text whose wide arrays are held at once.
SLAB = 1 << 21
CLASSES = 14


def _classes() -> np.ndarray:
    """Byte classes: 0 blank, 1 line end, 2 lower, 3 upper, 4 digit, 5 of a longer character, 6-12 marks, 13 others."""
    of = np.full(256, 13, np.uint8)
    of[[9, 11, 12, 13, 32]] = 0
    of[10] = 1
    of[97:123], of[65:91], of[48:58], of[128:] = 2, 3, 4, 5
    for i, marks in enumerate((b".", b",;:", b"!?", b"|", b"#*$%&", b"<>{}[]=\\/_^~@+", b"'\"()-`")):
        of[list(marks)] = 6 + i
    return of


_OF = _classes()
REPEATS = 3
WIDTH = CLASSES * CLASSES + REPEATS + 2


def _repeats(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """True where the value occurs more than once in its group."""
    mixed = value ^ (group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(mixed)
    s = mixed[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(s), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (n, WIDTH), and how many each text has (one at least).

    Some 16 bytes are held for each byte of text; what takes more is done in slabs of words.
    """
    parts = [x.encode("utf-8", "replace") for x in texts]
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    size = np.array([len(x) + 1 for x in parts])
    doc = np.repeat(np.arange(len(parts), dtype=np.int32), size)
    of = _OF[raw]
    inside = of > 1
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = np.flatnonzero(first)
    word_doc = doc[begin]
    n_words = np.bincount(word_doc, minlength=len(parts))
    count = np.maximum(1, -(-n_words // PASSAGE))
    base = np.cumsum(count) - count
    nth = np.arange(len(begin)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    word_passage = (base[word_doc] + nth // PASSAGE).astype(np.int32)
    total = int(count.sum())
    # a byte belongs to the passage of the last word begun before it in its text
    passage = base.astype(np.int32)[doc]
    if len(begin):
        seen = np.maximum(np.cumsum(first, dtype=np.int32) - 1, 0)
        mine = (doc == word_doc[seen]) & (np.arange(len(raw)) >= begin[0])
        np.copyto(passage, word_passage[seen], where=mine)
        del seen, mine
    x = np.zeros((total, WIDTH), np.float32)
    cells = CLASSES * CLASSES
    for i in range(0, len(raw) - 1, SLAB):
        # passages follow each other: a slab touches a range of them
        at = passage[i : min(i + SLAB, len(raw) - 1)]
        low, high = int(at[0]), int(at[-1]) + 1
        code = (at - low).astype(np.int64) * cells + of[i : i + len(at)] * np.int64(CLASSES) + of[i + 1 : i + 1 + len(at)]
        same = doc[i : i + len(at)] == doc[i + 1 : i + 1 + len(at)]  # no pair spans two texts
        x[low:high, :cells] += np.bincount(code[same], minlength=(high - low) * cells).reshape(-1, cells)
    bytes_ = x[:, :cells].sum(1, keepdims=True)
    x[:, :cells] = np.sqrt(x[:, :cells] / np.maximum(bytes_, 1))
    if len(begin):
        # hash of each word: a polynomial over its bytes
        ends = np.append(begin[1:], len(raw))
        power = np.full(int((ends - begin).max()), 0x100000001B3, np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        h = np.empty(len(begin), np.uint64)
        w = 0
        while w < len(begin):
            v = max(w + 1, int(np.searchsorted(ends, begin[w] + SLAB, "right")))
            a, b = begin[w], ends[v - 1]
            starts = begin[w:v] - a
            offset = np.arange(b - a) - np.repeat(starts, np.diff(np.append(starts, b - a)))
            h[w:v] = np.add.reduceat(np.where(inside[a:b], (raw[a:b].astype(np.uint64) + np.uint64(1)) * power[offset], np.uint64(0)), starts)
            w = v
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        words = np.bincount(word_passage, minlength=total)
        gram = h
        for k in range(REPEATS):
            if k:
                gram = gram[:-1] * np.uint64(31) + h[k:]
            whole = word_doc[: len(gram)] == word_doc[len(h) - len(gram) :] if k else np.ones(len(h), bool)
            twice = _repeats(word_doc[: len(gram)], gram) & whole
            x[:, cells + k] = np.bincount(word_passage[: len(gram)], twice, total) / np.maximum(words, 1)
        x[:, -2] = words / PASSAGE
    x[:, -1] = np.log1p(np.repeat(n_words, count)) / 8
    return x, count


@dataclass
class Model:
    """Weights of encoder, attention and output; mean is the score where nothing could be learned."""

    weights: dict[str, np.ndarray]
    mean: float | None = None

    def forward(self, x: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        starts = np.cumsum(count) - count
        x = (x - w["mu"]) / w["sd"]
        h = np.maximum(x @ w["We"] + w["be"], 0)
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * g) @ w["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), count))
        a = e / np.repeat(np.add.reduceat(e, starts), count)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -30, 30)))}

    def score(self, texts: list[str]) -> np.ndarray:
        if self.mean is not None:
            return np.full(len(texts), self.mean)
        return self.forward(*passages(texts))["p"].astype(np.float64)


def gradients(model: Model, x: np.ndarray, count: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Derivatives of the mean log loss of the documents by the learned weights."""
    w, o = model.weights, model.forward(x, count)
    begin, of = np.cumsum(count) - count, np.repeat(np.arange(len(count)), count)
    d = ((o["p"] - y) / len(count)).astype(x.dtype)
    dz = d[:, None] * w["c"]
    dh = o["a"][:, None] * dz[of]
    da = (o["h"] * dz[of]).sum(1)
    de = o["a"] * (da - np.add.reduceat(o["a"] * da, begin)[of])
    dt, dg = de[:, None] * w["w"] * o["g"] * (1 - o["t"] ** 2), de[:, None] * w["w"] * o["t"] * o["g"] * (1 - o["g"])
    dh += dt @ w["V"].T + dg @ w["U"].T
    dh *= o["h"] > 0
    return {"We": o["x"].T @ dh, "be": dh.sum(0), "V": o["h"].T @ dt, "U": o["h"].T @ dg, "w": (o["t"] * o["g"]).T @ de, "c": o["z"].T @ d, "b": d.sum(keepdims=True)}


def fit(x: np.ndarray, count: np.ndarray, y: np.ndarray, hidden: int = 32, gate: int = 16, epochs: int = 40, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Model:
    """Minimises the log loss of the documents' labels with Adam."""
    if not len(y) or y.min() == y.max():
        return Model({}, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    f = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    w = {"mu": x.mean(0), "sd": x.std(0) + 1e-2, "We": f(x.shape[1], hidden), "be": np.zeros(hidden, np.float32), "V": f(hidden, gate), "U": f(hidden, gate), "w": f(gate), "c": f(hidden), "b": np.zeros(1, np.float32)}
    model, learned = Model(w), ("We", "be", "V", "U", "w", "c", "b")
    m1, m2 = ({k: np.zeros_like(w[k]) for k in learned} for _ in range(2))
    starts, step = np.cumsum(count) - count, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            docs = order[i : i + batch]
            n = count[docs]
            rows = np.repeat(starts[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            step += 1
            lr = rate * (1 - epoch / epochs)
            for k, grad in gradients(model, x[rows], n, y[docs]).items():
                grad = grad + decay * w[k]
                m1[k] = 0.9 * m1[k] + 0.1 * grad
                m2[k] = 0.999 * m2[k] + 0.001 * grad**2
                w[k] -= (lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(w[k].dtype)
    return model


def _chunks(texts: list[str]) -> Iterator[slice]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK):
            size += len(texts[j])
            j += 1
        yield slice(i, j)
        i = j


def longest(count: np.ndarray, rows: np.ndarray, most: int) -> int:
    """The largest m for which the sum of min(count, m) over all rows is at most ``most``; 1 at least."""
    low, high = 1, int(count.max(initial=1))
    while low < high:
        m = (low + high + 1) // 2
        low, high = (m, high) if (np.minimum(count, m) * rows).sum() <= most else (low, m - 1)
    return low


def pooled(x: np.ndarray, most: int) -> np.ndarray:
    """The passages of one text as ``most`` means of neighbours at most; frequencies are averaged, not their roots."""
    if len(x) <= most:
        return x
    starts = -(-np.arange(most) * len(x) // most)
    out = x.astype(np.float64)
    out[:, : CLASSES * CLASSES] **= 2
    out = np.add.reduceat(out, starts) / np.diff(np.append(starts, len(x)))[:, None]
    out[:, : CLASSES * CLASSES] **= 0.5
    return out.astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, documents: int = FIT_DOCUMENTS, most_passages: int = FIT_PASSAGES, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fits on a bounded sample of the rows of ``labels``, which holds keys and labels only."""
    lab = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(label).cast("double").alias("_y"))
    lab = lab.groupBy("_k").agg(F.max("_y").alias("_y"))
    sample = lab.orderBy(F.xxhash64(F.lit("fit"), "_k"), "_k").limit(documents)
    rows = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t")).join(F.broadcast(sample), "_k").select("_k", "_y", "_t")
    rows = taken = materialize(rows.withColumn("_h", F.xxhash64("_k", "_t")), "fit-sample")
    words = F.length(F.translate(F.regexp_replace("_t", WORD, "x"), " \t\n\x0b\x0c\r", ""))
    sizes = rows.groupBy(F.greatest(F.ceil(words / F.lit(PASSAGE)), F.lit(1)).cast("long").alias("n")).agg(F.count("*").alias("rows")).collect()
    n, times = (np.array([getattr(r, c) for r in sizes], np.int64) for c in ("n", "rows"))
    share = longest(n, times, most_passages)
    if times.sum() > most_passages:
        # more rows than passages share the sampled keys: the first in hash order, with a passage each
        rows = rows.orderBy("_h", "_k").limit(most_passages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for part in _chunks(texts):
                x, count = passages(texts[part])
                ends = np.cumsum(count)
                raw = [pooled(x[e - n : e], share).tobytes() for e, n in zip(ends, count, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string())[part], b.column(1)[part], pa.array(np.minimum(count, share), pa.int64()), pa.array(raw, pa.binary())], ["k", "y", "n", "x"])

    bags = map_arrow(rows.select("_k", "_y", "_t"), run, "k string, y double, n bigint, x binary")
    bags = sorted(bags.collect(), key=lambda r: (zlib.crc32(r.x), r.k, r.x))  # in an order of their own: refits agree
    forget(taken)
    x = np.concatenate([np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in bags]) if bags else np.zeros((0, WIDTH), np.float32)
    return fit(x, np.array([r.n for r in bags], np.int64), np.array([r.y for r in bags], np.float32))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' key, the score and the prediction."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            for part in _chunks(texts):
                p = model.score(texts[part])
                yield pa.RecordBatch.from_arrays([b.column(0)[part], pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["key", "score", "predicted"])

    out = map_arrow(docs.select(key, text), run, "key " + kind + ", score double, predicted int")
    return out.withColumnRenamed("key", key)


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column(at).to_pylist()]
            good = [model.score(texts[part]) >= threshold for part in _chunks(texts)]
            yield b.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    return map_arrow(docs, run, docs.schema)
