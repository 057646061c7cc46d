"""Language identification by mixture inference.

Each language has a distribution over hashed byte trigrams of letters, counted over all training documents; a letter
that stands alone has one, too, between two blanks. A document's trigrams are taken as drawn from a mixture of the languages; expectation-maximisation estimates the
proportions. The language set is chosen by penalised likelihood: starting with all languages, the one with the
smallest proportion leaves as long as the log-likelihood lost is below ``penalty`` x log(number of trigrams). The
prediction is the language with the largest proportion, the score that proportion.

Defined results: a text that is null or has no letter (marks, digits and fractions are none) is ``und`` with score 0; ties go to the first language by name;
training rows without text or language teach nothing; with nothing learned every text is ``und``; repeated rows are
predicted each; an empty table gives an empty result; other columns of the input are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import map_arrow

BUCKETS = 1 << 13
STEPS = 12
PENALTY = 4.0
#: Texts whose trigrams lie in arrays at once: so many bytes, one text at least.
CHUNK = 1 << 21
#: Everything but ASCII letters and bytes of longer characters becomes a blank.
_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def held_out(key: str = "doc_id") -> Column:
    """The fold that is kept for testing."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text and bucket that occurs in it: text, bucket, count; ordered by text."""
    parts = [x.lower().encode("utf-8", "replace").translate(_FOLD) for x in texts]
    if len(parts) == 1:
        # one text, maybe a very long one: counted in slabs, whose first and last byte are only looked at
        raw, n = np.frombuffer(b" " + parts[0] + b" ", np.uint8), np.zeros(BUCKETS, np.int64)
        for i in range(0, len(parts[0]), CHUNK):
            n += np.bincount(_hashed(raw[i : i + CHUNK + 2])[0], minlength=BUCKETS)
        there = np.flatnonzero(n)
        return np.zeros(len(there), np.int64), there, n[there]
    # blanks keep the texts apart: no counted trigram spans two, and each belongs to the text of its middle byte
    raw = np.frombuffer(b"   ".join([b"", *parts, b""]), np.uint8)
    owner = np.concatenate([np.zeros(3, np.int64), np.repeat(np.arange(len(parts), dtype=np.int64), [len(x) + 3 for x in parts])])
    hashed, use = _hashed(raw)
    cell, n = np.unique(owner[1:-1][use] * BUCKETS + hashed, return_counts=True)
    return cell // BUCKETS, cell % BUCKETS, n


def _hashed(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams whose middle byte is none of the blanks, and where those are."""
    a, b, c = raw[:-2], raw[1:-1], raw[2:]
    use = b != 32
    code = a.astype(np.uint32) << 16 | b.astype(np.uint32) << 8 | c
    return ((code[use] * np.uint32(2654435761)) >> np.uint32(32 - 13)).astype(np.int64), use


def _chunks(texts: list[str]) -> Iterator[slice]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK):
            size += len(texts[j])
            j += 1
        yield slice(i, j)
        i = j


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their smoothed trigram distributions (languages, BUCKETS), from all rows with text and language.

    Tasks emit counts per language and bucket once, Spark sums them; the driver gets that table, whatever the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for part in _chunks(texts):
                doc, bucket, n = trigrams(texts[part])
                names = sorted(set(langs[part]))
                at = np.array([names.index(x) for x in langs[part]])
                dense = np.bincount(at[doc] * BUCKETS + bucket, n, len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for x, row in zip(names, dense, strict=True):
                    sums[x] = sums.get(x, 0) + row
        for x, row in sums.items():
            there = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(there), pa.string()), pa.array(there, pa.int32()), pa.array(row[there].astype(np.int64))], ["lang", "bucket", "n"])

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string"), text)
    counts = map_arrow(rows, run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique())
    table = np.full((len(names), BUCKETS), 0.5)
    table[[names.index(x) for x in counts["lang"]], counts["bucket"]] += counts["n"]
    return names, table / table.sum(1, keepdims=True)


def infer(texts: list[str], table: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> np.ndarray:
    """Proportions (texts, languages) of the chosen sets; rows of zeros where there is no trigram."""
    n_langs = len(table)
    doc, bucket, n = trigrams(texts)
    pi = np.zeros((len(texts), n_langs))
    if not len(doc) or not n_langs:
        return pi
    there, starts = np.unique(doc, return_index=True)
    local = np.repeat(np.arange(len(there)), np.diff(np.append(starts, len(doc))))
    like = np.ascontiguousarray(table[:, bucket].T)
    weight = n.astype(np.float64)[:, None]
    total = np.add.reduceat(weight[:, 0], starts)

    def climb(p: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """EM for the documents of ``rows`` (a mask); proportions of 0 stay 0. Also their log-likelihoods."""
        mine = rows[local]
        lk, wt = like[mine], weight[mine]
        sizes = np.diff(np.append(starts, len(doc)))[rows]
        at, to = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        q = p[rows]
        for _ in range(steps):
            joint = lk * q[to]
            q = np.add.reduceat(joint * (wt / joint.sum(1, keepdims=True)), at) / total[rows][:, None]
        return q, np.add.reduceat(np.log((lk * q[to]).sum(1)) * wt[:, 0], at)

    everything = np.ones(len(there), bool)
    q, best = climb(np.full((len(there), n_langs), 1.0 / n_langs), everything)
    open_ = everything & (n_langs > 1)
    while open_.any():
        # without the smallest proportion of each open document
        last = np.where(q > 0, q, np.inf).argmin(1)
        trial = q.copy()
        trial[np.arange(len(q)), last] = 0
        trial /= np.maximum(trial.sum(1, keepdims=True), 1e-300)
        fitted, ll = climb(trial, open_)
        fine = best[open_] - ll < penalty * np.log(total[open_] + 1)
        at = np.flatnonzero(open_)
        q[at[fine]], best[at[fine]] = fitted[fine], ll[fine]
        open_[at[~fine]] = False
        open_ &= (q > 0).sum(1) > 1
    pi[there] = q
    return pi


def identify(docs: DataFrame, names: list[str], table: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, lang_pred, score, and the proportions of its language set."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x if x and any(map(str.isalpha, x)) else "" for x in b.column(1).to_pylist()]
            for part in _chunks(texts):
                pi = infer(texts[part], table)
                best = pi.argmax(1) if len(names) else np.zeros(len(pi), int)
                known = pi.any(1)
                score = np.where(known, pi.max(1, initial=0), 0.0)
                preds = [names[i] if k else "und" for i, k in zip(best, known, strict=True)]
                sets = [[(names[i], float(row[i])) for i in np.flatnonzero(row)] for row in pi]
                yield pa.RecordBatch.from_arrays([b.column(0)[part], pa.array(preds, pa.string()), pa.array(score), pa.array(sets, pa.map_(pa.string(), pa.float64()))], ["key", "lang_pred", "score", "proportions"])

    out = map_arrow(docs.select(key, text), run, f"key {kind}, lang_pred string, score double, proportions map<string,double>")
    return out.withColumnRenamed("key", key)
