"""N-gram Jaccard join: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. Every text gets a MinHash signature of 125 values. Equal texts are one text from here on, with a number of copies.
2. 25 bands of 5 values deal the texts into buckets. Inside a bucket, pairs are compared a few MinHash values at a
   time; a pair is dropped as soon as the posterior probability (binomial likelihood, uniform prior) that its
   similarity reaches the threshold falls below ``TOLERANCE``, and is left to the first bucket that both texts share.
   A bucket hands on how its surviving pairs connect, one row a text at most, never the pairs.
3. The connected candidates form families. Within a family all pairs whose sizes allow the threshold are verified
   exactly, by counting shared shingles (a product of incidence matrices), which also finds pairs that the bands or the
   pruning missed. Sizes fall into classes so wide that only texts of one class or of two neighbouring ones can be linked.
4. Links are summed per text; connected components of exact links are the classes.

A pair with similarity 0.8 shares no band with probability 5e-5, and then is lost only if no third text joins the two.
Buckets and families of any size are cut into blocks (by texts and by bytes) that meet two at a time, so no task holds a
whole group.

Defined results: a null text, or one without words, has no shingle and is a class of its own; a text of fewer than
five words has one shingle, all its words; repeated rows are copies; a class is named by its smallest key (null if it has
none); an empty table gives an empty result; other columns of the input are left behind, or kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from math import comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import components, map_arrow, materialize, release, small, written

SHINGLE = 5
THRESHOLD = Fraction(4, 5)
BANDS, ROWS = 25, 5
VALUES = BANDS * ROWS
TOLERANCE = 1e-5
#: Texts of a bucket or family that are held at once; two blocks meet in a task.
BLOCK = 512
BLOCK_BYTES = 16 << 20
#: Cells of an incidence matrix.
CELLS = 4_000_000
_rng = np.random.default_rng(20_250)
_A = _rng.integers(1 << 8, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(h))
    s = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        s *= np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(31)
        s += h[k : len(h) - n + 1 + k]
    s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty set, 16 bits each."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        least = np.minimum(least, (x[i : i + 2048, None] * _A + _B).min(0))
    # the smallest values are small: their low bits tell sets apart
    return ((least * np.uint32(2654435761)) >> np.uint32(16)).astype("<u2")


@lru_cache(maxsize=8)
def least_matches(threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """After k values, the matches below which P(similarity >= threshold) < tolerance."""
    t, out = float(threshold), []
    for k in range(VALUES + 1):
        below, m = 0.0, 0
        while m <= k:
            below += comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out.append(m)
    return tuple(out)


def _union(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest connected index of each of n."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, lab[i], low)
        np.minimum.at(new, lab[j], low)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows sorted by their first columns, regrouped so that no group is cut: tables of whole groups."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        differs = np.zeros(b.num_rows, bool)
        for c in range(keys):
            v = b.column(c).to_numpy(zero_copy_only=False)
            differs[1:] |= v[1:] != v[:-1]
        if held:
            prev = held[-1]
            differs[0] = any(prev.column(c)[prev.num_rows - 1] != b.column(c)[0] for c in range(keys))
        starts = np.flatnonzero(differs)
        if len(starts):
            cut = int(starts[-1])
            whole = [*held, b.slice(0, cut)] if cut else held
            if whole:
                yield pa.Table.from_batches(whole)
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _prune(threshold: Fraction, tolerance: float):
    """Links of surviving pairs in sorted buckets (bucket, block, other block, band, text, its block, signature)."""
    need = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 3):
            bucket, bi, bj, band, tid, mine = (t.column(c).to_numpy() for c in range(6))
            sig = np.frombuffer(b"".join(t.column(6).to_pylist()), "<u2").reshape(-1, VALUES)
            head = np.ones(len(tid), bool)
            head[1:] = (bucket[1:] != bucket[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])
            begins = np.append(np.flatnonzero(head), len(tid))
            after = np.repeat(begins[1:], np.diff(begins)) - np.arange(len(tid)) - 1  # rows of the group that follow
            order = np.argsort(-after, kind="stable")
            many = -after[order]
            kept: list[np.ndarray] = []
            for d in range(1, int(after.max(initial=0)) + 1):
                i = order[: np.searchsorted(many, -d, "right")]
                j = i + d
                cross = bi[i] != bj[i]
                ok = ~cross | (mine[i] != mine[j])
                i, j = i[ok], j[ok]
                matches = np.zeros(len(i), np.int64)
                for v in range(0, VALUES, 25):
                    if not len(i):
                        break
                    same = sig[i, v : v + 25] == sig[j, v : v + 25]
                    shared = same.reshape(len(i), -1, ROWS).all(2)
                    earlier = (shared & (np.arange(v // ROWS, v // ROWS + shared.shape[1]) < band[i][:, None])).any(1)
                    matches += same.sum(1)
                    ok = ~earlier & (matches >= need[v + 25])
                    i, j, matches = i[ok], j[ok], matches[ok]
                if len(i):
                    kept.append(np.stack([i, j]))
            if kept:
                i, j = np.concatenate(kept, 1)
                lab = _union(len(tid), i, j)
                linked = np.flatnonzero(lab != np.arange(len(tid)))
                yield pa.RecordBatch.from_arrays([pa.array(tid[linked]), pa.array(tid[lab[linked]])], ["a", "b"])

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """(n, n): shingles that two sets have in common."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    value, code, df = np.unique(np.concatenate(sets) if n else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    often = df > 1
    column = np.cumsum(often) - 1
    use = often[code]
    owner, code = owner[use], column[code[use]]
    out, width = np.zeros((n, n), np.float64), max(1, CELLS // max(1, n))
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for start in range(0, int(often.sum()), width):
        a, b = np.searchsorted(code, (start, start + width))
        m = np.zeros((n, min(width, int(often.sum()) - start)), np.float32)
        m[owner[a:b], code[a:b] - start] = 1
        out += m @ m.T
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return out


def _verify(threshold: Fraction, size: int):
    """Exact links in sorted families (family, size class, block, other block, text id, its block, whether its own class is
    the next one, copies, text): one row a linked text. Two texts of the next class meet in that class."""
    p, q = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 4):
            fam, cls, bi, bj, tid, mine, upper, copies = (t.column(c).to_numpy() for c in range(8))
            texts = t.column(8)
            head = np.ones(len(tid), bool)
            head[1:] = (fam[1:] != fam[:-1]) | (cls[1:] != cls[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])
            begins = np.append(np.flatnonzero(head), len(tid))
            found: list[tuple[np.ndarray, ...]] = []
            for a, b in zip(begins, begins[1:], strict=False):
                at = a + np.flatnonzero(np.append(True, tid[a + 1 : b] != tid[a : b - 1]))  # a repeated row comes once
                if len(at) < 2 or upper[at].all():
                    continue
                sets = [shingles(texts[int(i)].as_py(), size) for i in at]
                n = np.array([len(s) for s in sets])
                shared = shared_counts(sets)
                # shared / (n_i + n_j - shared) >= p / q, in whole numbers
                linked = (p + q) * shared >= p * (n[:, None] + n)
                linked &= (n[:, None] > 0) & ~np.eye(len(at), dtype=bool) & ~(upper[at][:, None] & upper[at])
                if bi[a] != bj[a]:
                    linked &= mine[at][:, None] != mine[at]
                i, j = np.nonzero(linked)
                if len(i):
                    lab = _union(len(at), i, j)
                    rows = np.flatnonzero(linked.any(1))
                    found.append((tid[at[rows]], tid[at[lab[rows]]], linked[rows] @ copies[at], linked[rows].sum(1)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found, strict=True)], ["a", "b", "n_links", "n_text_links"])

    return run


def _blocked(rows: DataFrame, count: str, by: str, n_bytes: str | None = None) -> DataFrame:
    """Adds block, other block and own block: one row for each pair of blocks of the group that the row takes part in."""
    blocks = F.ceil(F.col(count) / F.lit(BLOCK))
    if n_bytes:
        blocks = F.greatest(blocks, F.ceil(F.col(n_bytes) / F.lit(BLOCK_BYTES)))
    rows = rows.withColumn("_blocks", blocks.cast("int")).withColumn("_mine", F.pmod(F.xxhash64(F.lit("block"), by), "_blocks").cast("int"))
    rows = rows.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return rows.withColumn("_bi", F.least("_mine", "_with")).withColumn("_bj", F.greatest("_mine", "_with"))


def _by_size(place: DataFrame, threshold: Fraction) -> DataFrame:
    """place with a row for each size class (_class) in which a text meets others, whether its own is the next one (_upper),
    and the texts and bytes that meet there (_n, _bytes)."""
    width = log(1 / float(threshold)) * (1 + 1e-6) if threshold < 1 else 1e-6
    own = place.withColumn("_own", F.floor(F.log(F.col("_size").cast("double")) / F.lit(width)).cast("long"))
    classes = own.groupBy("comp", "_own").agg(F.count("*").alias("_n0"), F.sum("_bytes").alias("_b0"))
    above = classes.select("comp", (F.col("_own") - 1).alias("_own"), F.col("_n0").alias("_n1"), F.col("_b0").alias("_b1"))
    meet = classes.join(above, ["comp", "_own"], "left").select(
        "comp", F.col("_own").alias("_class"), (F.col("_n0") + F.coalesce("_n1", F.lit(0))).alias("_n"), (F.col("_b0") + F.coalesce("_b1", F.lit(0))).alias("_group_bytes")
    )
    rows = own.withColumn("_class", F.explode(F.array(F.col("_own"), F.col("_own") - 1)))
    return rows.join(meet, ["comp", "_class"]).withColumn("_upper", F.col("_own") > F.col("_class"))


def join(docs: DataFrame, threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE, size: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: _row, _key, _text_key, _size (shingles), class_row (a row of the class), n_copies, n_links, n_text_links.

    n_links counts the other documents whose similarity reaches the threshold, copies included; n_text_links the
    other texts.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("_text_key"), F.col(text).alias("_text"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("_bytes"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x, size) for x in b.column(3).to_pylist()]
            sigs = [signature(s).tobytes() if len(s) else b"" for s in sets]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], b.column(4), pa.array([len(s) for s in sets], pa.int32()), pa.array(sigs, pa.binary())], ["_row", "_key", "_text_key", "_bytes", "_size", "_sig"])

    base = materialize(map_arrow(rows, sign, f"_row bigint, _key {kind}, _text_key binary, _bytes bigint, _size int, _sig binary"), "join-signatures")
    texts = base.where("_size > 0").groupBy("_text_key").agg(F.min("_row").alias("_tid"), F.count("*").alias("_copies"), F.max("_size").alias("_size"), F.max("_bytes").alias("_bytes"))
    texts = materialize(texts, "join-texts")
    signed = base.select(F.col("_row").alias("_tid"), "_sig").join(texts.select("_tid"), "_tid")
    signed = materialize(signed, "join-signed")

    bands = signed.select("_tid", F.explode(F.expr(f"transform(sequence(0, {BANDS - 1}), j -> struct(j AS band, xxhash64(j, substring(_sig, j * {2 * ROWS} + 1, {2 * ROWS})) AS bucket))")).alias("_b"))
    bands = bands.select("_tid", "_b.band", "_b.bucket")
    shared = bands.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1")
    met = _blocked(bands.join(shared, "bucket"), "_n", "_tid").join(signed, "_tid")
    met = met.select("bucket", "_bi", "_bj", "band", "_tid", "_mine", "_sig")
    met = met.repartition("bucket", "_bi", "_bj").sortWithinPartitions("bucket", "_bi", "_bj", "_tid")
    near = map_arrow(met, _prune(threshold, tolerance), "a bigint, b bigint")
    family = materialize(components(near, "join-candidates"), "join-families")

    place = family.join(texts, family.node == texts._tid).select("comp", "_tid", "_copies", "_size", "_bytes", "_text_key")
    place = materialize(place.join(base.select(F.col("_row").alias("_tid"), F.col("_key").alias("_owner")), "_tid"), "join-place")
    # a text comes from the document that stands for its copies: found by text and key, so that copies are no hot key
    named = place.select("_tid", F.col("_text_key").alias("_of"), "_owner")
    taken = rows.select("_key", "_text_key", "_text").join(small(named), (F.col("_text_key") == F.col("_of")) & F.col("_key").eqNullSafe(F.col("_owner")))
    # rows repeated under that key come once
    taken = taken.select("_tid", "_text").dropDuplicates(["_tid"])
    met = _blocked(_by_size(place, threshold), "_n", "_tid", "_group_bytes").select("comp", "_class", "_bi", "_bj", "_tid", "_mine", "_upper", "_copies")
    sets = met.join(taken, "_tid").select("comp", "_class", "_bi", "_bj", "_tid", "_mine", "_upper", "_copies", "_text")
    sets = sets.repartition("comp", "_class", "_bi", "_bj").sortWithinPartitions("comp", "_class", "_bi", "_bj", "_tid")
    exact = materialize(map_arrow(sets, _verify(threshold, size), "a bigint, b bigint, n_links bigint, n_text_links bigint"), "join-links")

    links = exact.groupBy(F.col("a").alias("_tid")).agg(F.sum("n_links").alias("n_links"), F.sum("n_text_links").alias("n_text_links"))
    classes = components(exact.select("a", "b"), "join-classes").select(F.col("node").alias("_tid"), "comp")
    per_text = texts.select("_text_key", "_tid", "_copies").join(links, "_tid", "left").join(classes, "_tid", "left")
    per_text = per_text.select("_text_key", "_tid", "_copies", F.coalesce("comp", "_tid").alias("class_row"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_text_links")])
    out = base.select("_row", "_key", "_text_key", "_size").join(per_text, "_text_key", "left")
    return out.select(
        "_row", "_key", "_text_key", "_size", F.coalesce("class_row", "_row").alias("class_row"), F.coalesce("_copies", F.lit(1)).cast("long").alias("n_copies"),
        (F.coalesce("n_links", F.lit(0)) + F.coalesce("_copies", F.lit(1)) - 1).cast("long").alias("n_links"), F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"),
    )


def similar(docs: DataFrame, threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE, size: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, class_id (the smallest key of its class), class_size, n_copies, n_links, n_text_links."""
    before = written()
    found = materialize(join(docs, threshold, tolerance, size, key, text), "join-result")
    release(before, found)
    # most documents are alone in their class: only the others are looked up, so that a large class is no hot join key
    names = found.groupBy("class_row").agg(F.min("_key").alias("class_id"), F.count("*").alias("class_size")).where("class_size > 1")
    alone = F.col("class_size").isNull()
    out = found.join(small(materialize(names, "join-names")), "class_row", "left").withColumn("class_id", F.when(alone, F.col("_key")).otherwise(F.col("class_id")))
    return out.select(F.col("_key").alias(key), "class_id", F.coalesce("class_size", F.lit(1)).alias("class_size"), "n_copies", "n_links", "n_text_links")


def one_of_each(docs: DataFrame, threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE, size: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class, the one with the smallest key (then the first row); all rows without words."""
    before = written()
    found = materialize(join(docs, threshold, tolerance, size, key, text).where("_size > 0"), "join-result")
    release(before, found)
    best = found.groupBy("class_row").agg(F.min(F.struct(F.col("_key").isNull(), "_key", "_row")).alias("_best")).select(F.col("_best._row").alias("_row"))
    keep = found.join(best, "_row", "left_semi").select("_key", "_text_key").withColumn("_kept", F.lit(True))
    # rows are told apart by key and text: what only dropped rows have goes, what a kept row has stays once
    pairs = found.groupBy("_key", "_text_key").agg(F.count("*").alias("_rows"))
    kept = keep.select(F.col("_key").alias("_k"), F.col("_text_key").alias("_t"), "_kept")
    state = pairs.join(kept, pairs["_key"].eqNullSafe(F.col("_k")) & (pairs["_text_key"] == F.col("_t")), "left")
    state = state.select(F.col("_key").alias("_jaccard_key"), F.col("_text_key").alias("_jaccard_text"), "_rows", F.coalesce("_kept", F.lit(False)).alias("_kept")).where("NOT _kept OR _rows > 1")
    state = materialize(state, "join-drops")
    own_text = F.unhex(F.md5(F.coalesce(docs[text], F.lit("")).cast("binary")))
    match = lambda rows: docs[key].eqNullSafe(rows["_jaccard_key"]) & (own_text == rows["_jaccard_text"])
    out = docs.join(small(state), match(state), "left_anti")
    again = state.where("_kept")
    if again.limit(1).count():
        repeated = docs.join(small(again), match(again), "left_semi")
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
        once = repeated.select(whole, F.col(key).alias("_k"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_t")).dropDuplicates(["_k", "_t"])
        out = out.unionByName(once.select("_doc.*"))
    return out
