"""Gradient-boosted regression trees with second-order splits, squared error.

gain = (S(GL)^2/(HL+r) + S(GR)^2/(HR+r) - S(G)^2/(H+r)) / 2 - gamma, with S the soft threshold by alpha; a leaf is
-rate S(G)/(H+r). Splits are sought over at most ``BINS`` quantile bins a feature: tasks sum gradient and weight per
(node, feature, bin) over chunks of rows, Spark adds their sums up, a table bounded by the model and not by the rows, and the
driver picks the best split of each node. A chunk holds a row's bins in a byte each, its residual and its number: a pass over all
rows is a pass over some 15 bytes a row. Rows are sampled by a number that Spark gives each row from its values, columns by (seed, tree), so results do not
depend on partitioning. The sampler is not that of any other library: equal settings give other trees.

``fit_arrays`` grows the same trees in memory, from the same bins, row numbers and weights, for many small fits at once
(folds x settings): which of the two fits is a matter of size and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.config import Boosting
from pulsegrid.shared import discard, materialize

BINS = 64
#: Trees after which the residuals are written anew.
REWRITE = 10
#: Rows that a task computes on at once.
CHUNK = 1 << 14
#: A prime below 2^31: row numbers and the sampler's lines are taken modulo it.
PRIME = 2_147_483_647
#: Up to so many rows a fold is fitted in one task; beyond, the folds are fitted one after the other by Spark, with the same results.
LOCAL_ROWS = 100_000

#: A node: tree, node, feature, threshold, yes (below or missing), no, leaf value, gain, cover.
Node = tuple


@dataclass
class Model:
    base: float
    nodes: list[Node] = field(default_factory=list)

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(x.values())))
        out = np.full(n, self.base)
        for tree in sorted({r[0] for r in self.nodes}):
            by = {r[1]: r for r in self.nodes if r[0] == tree}
            at = np.zeros(n, int)
            while True:
                inner = [k for k in np.unique(at) if by[k][2] is not None]
                if not inner:
                    break
                for k in inner:
                    here, v = at == k, x[by[k][2]]
                    at[here] = np.where(~(v[here] >= by[k][3]), by[k][4], by[k][5])
            out += np.array([by[k][6] for k in at])
        return out


def sample_weight(target: str, settings: Boosting) -> Column:
    return F.when(F.col(target) >= settings.high_value, F.lit(settings.high_weight)).otherwise(F.lit(1.0))


def tree_expression(nodes: Iterable[Node], tree: int) -> Column:
    by = {r[1]: r for r in nodes if r[0] == tree}

    def build(k: int) -> Column:
        _, _, feature, threshold, yes, no, leaf, *_ = by[k]
        return F.lit(float(leaf)) if feature is None else F.when(F.col(feature) >= threshold, build(no)).otherwise(build(yes))

    return build(0)


def score_expression(nodes: Sequence[Node], base: float, floor: float | None = None) -> Column:
    """The prediction as one expression of nested cases; missing values go the ``yes`` way."""
    out = F.lit(float(base))
    for tree in sorted({r[0] for r in nodes}):
        out = out + tree_expression(nodes, tree)
    return out if floor is None else F.greatest(F.lit(floor), out)


def _soft(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def _columns(columns: Sequence[str], s: Boosting, tree: int) -> list[int]:
    rng = np.random.default_rng((s.seed, tree))
    k = max(1, int(round(s.columns * len(columns))))
    return sorted(rng.permutation(len(columns))[:k].tolist())


def _best(g: np.ndarray, h: np.ndarray, usable: list[int], cuts: list[np.ndarray], s: Boosting) -> tuple[float, int, int, float, float] | None:
    """(gain, feature, bin, sums of the left side) of the best split of one node; g, h: (features, bins) sums."""
    total_g, total_h = g[usable[0]].sum(), h[usable[0]].sum()
    value = lambda a, b: _soft(a, s.alpha) ** 2 / (b + s.ridge)
    best = None
    for f in usable:
        gl, hl = np.cumsum(g[f])[: len(cuts[f])], np.cumsum(h[f])[: len(cuts[f])]
        gr, hr = total_g - gl, total_h - hl
        gain = (value(gl, hl) + value(gr, hr) - value(total_g, total_h)) / 2 - s.gamma
        gain = np.where((hl >= s.min_weight) & (hr >= s.min_weight), gain, -np.inf)
        if len(gain) and gain.max() > (best[0] if best else 0.0) + 1e-12:
            k = int(gain.argmax())
            best = float(gain[k]), f, k, float(gl[k]), float(hl[k])
    return best


def _grow(histogram, columns: Sequence[str], cuts: list[np.ndarray], s: Boosting, tree: int) -> list[Node]:
    """One tree; histogram(nodes so far, open nodes) gives {node: (g, h)} with (features, bins) sums.

    The sums of the last level's nodes are those of the splits above them: no histogram is made for leaves.
    """
    usable, nodes, open_, next_, known = _columns(columns, s, tree), {}, [0], 1, {}
    for level in range(s.depth + 1):
        sums = histogram(list(nodes.values()), open_) if level < s.depth or level == 0 else {}
        following = []
        for k in open_:
            if k in sums:
                g, h = sums[k]
                total, cover = float(g[usable[0]].sum()), float(h[usable[0]].sum())
            else:
                g, h, (total, cover) = None, None, known.get(k, (0.0, 0.0))
            split = _best(g, h, usable, cuts, s) if level < s.depth and g is not None else None
            if split:
                gain, f, b, left_g, left_h = split
                nodes[k] = (tree, k, columns[f], float(cuts[f][b]), next_, next_ + 1, None, gain, cover)
                known[next_], known[next_ + 1] = (left_g, left_h), (total - left_g, cover - left_h)
                following += [next_, next_ + 1]
                next_ += 2
            else:
                nodes[k] = (tree, k, None, None, None, None, float(-s.rate * _soft(total, s.alpha) / (cover + s.ridge)), None, cover)
        open_ = following
        if not open_:
            break
    return [nodes[k] for k in sorted(nodes)]


def _place(splits: Sequence[tuple[int, int, int, int]], bins: np.ndarray) -> np.ndarray:
    """The node of each row: where the splits lead; bins: (features, rows)."""
    kind = np.min_scalar_type(max((yes + 1 for *_, yes in splits), default=0)).type
    at = np.zeros(bins.shape[1], kind)
    for k, f, b, yes in splits:
        at = np.where(at == k, kind(yes) + (bins[f] > b), at)
    return at


def _splits(nodes: Iterable[Node], columns: Sequence[str], cuts: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    """Splits by bins, parents first: node, feature, last bin of its yes side, the yes side's node (the no side's is the next)."""
    place = {c: i for i, c in enumerate(columns)}
    inner = ((r[1], place[r[2]], r) for r in nodes if r[2] is not None)
    return sorted((k, f, int(np.searchsorted(cuts[f], r[3])), r[4]) for k, f, r in inner)


def _bin(x: Column, cut: np.ndarray) -> Column:
    """How many cuts a value reaches; 0 where it is missing."""
    if not len(cut):
        return F.lit(0)
    reached = F.size(F.filter(F.array(*[F.lit(float(t)) for t in cut]), lambda t: x >= t))
    return F.when(x.isNull(), 0).otherwise(reached)


#: Cells over a feature's range, and cells an octave, whose overlaps a feature's values are counted in.
CELLS, PER_OCTAVE = 4096, 64


def cuts_of(df: DataFrame, columns: Sequence[str]) -> list[np.ndarray]:
    """Thresholds of each feature: values at its quantiles over all rows of df, whatever their partitioning.

    Values are counted in cells of equal width and of equal ratio at once (both grow with the value, so the overlaps are intervals
    in order). A threshold is the largest value of the cell in which the count reaches its share; where a cell holds one
    value it is the exact quantile, else it is off by a cell: 1/4096 of the range and a ratio of 1.011 at most. The driver gets cells,
    whose number does not grow with the rows.
    """
    top = F.lit(float("inf"))
    rows = df.select(*[F.when(F.abs(F.col(c).cast("double")) < top, F.col(c).cast("double")).alias(c) for c in columns])
    facts = rows.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    parts = []
    for i, c in enumerate(columns):
        x, lo, hi = F.col(c), facts[f"{c}_lo"], facts[f"{c}_hi"]
        if lo is None:
            continue
        even = F.floor((x / 2 - lo / 2) / (hi / 2 - lo / 2) * CELLS) if hi / 2 > lo / 2 else F.lit(0)
        octave = F.when(x == 0, F.lit(0)).otherwise(F.signum(x) * (F.floor(F.log2(F.abs(x)) * PER_OCTAVE) + 1100 * PER_OCTAVE))
        parts.append(F.when(x.isNotNull(), F.struct(F.lit(i).alias("i"), even.cast("int").alias("even"), octave.cast("int").alias("octave"), x.alias("x"))))
    if not parts:
        return [np.zeros(0) for _ in columns]
    cells = rows.select(F.explode(F.array(*parts)).alias("p")).where("p IS NOT NULL").select("p.*")
    found: dict[int, list[tuple[float, int]]] = {}
    for r in cells.groupBy("i", "even", "octave").agg(F.max("x").alias("x"), F.count("*").alias("n")).collect():
        found.setdefault(r.i, []).append((r.x, r.n))
    out = []
    for i in range(len(columns)):
        x, n = (np.array(v) for v in zip(*sorted(found.get(i, [(0.0, 0)])), strict=True))
        reached = np.cumsum(n)
        out.append(np.unique(x[np.searchsorted(reached, np.arange(1, BINS) / BINS * reached[-1], "left")]) if reached[-1] else np.zeros(0))
    return out


def prepared(df: DataFrame, columns: Sequence[str], target: str, cuts: list[np.ndarray], weight: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """What a fit needs of each row with a target: _y, _w, _bins and the row's number _u."""
    bins = [_bin(F.col(c), cut) for c, cut in zip(columns, cuts, strict=True)]
    rows = df.where(F.col(target).isNotNull())
    number = F.pmod(F.xxhash64(F.lit("row"), target, *columns), F.lit(PRIME))
    return rows.select(*keep, *columns, F.col(target).cast("double").alias("_y"), (weight if weight is not None else F.lit(1.0)).alias("_w"), F.array(*bins).alias("_bins"), number.alias("_u"))


def _line(s: Boosting, tree: int) -> tuple[int, int, int]:
    """a, b and c: the rows with (a u + b) mod PRIME < c are the tree's sample."""
    rng = np.random.default_rng((s.seed, tree, 1))
    return int(rng.integers(1, PRIME)), int(rng.integers(0, PRIME)), int(s.rows * PRIME)


CHUNKS = "bins binary, residual binary, weight binary, number binary"


def _chunk(bins: np.ndarray, residual: np.ndarray, weight: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array([v.tobytes()], pa.binary()) for n, v in zip(("bins", "residual", "weight", "number"), (bins, residual, weight, number), strict=True)})


def _chunks(part: pa.RecordBatch, features: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Bins (features, rows), residuals, weights (none: all 1) and numbers of each chunk."""
    for bins, *rest in zip(*(part.column(i) for i in range(4)), strict=True):
        r, w, u = (np.frombuffer(v.as_buffer(), kind) for v, kind in zip(rest, (np.float64, np.float64, np.uint32), strict=True))
        yield np.frombuffer(bins.as_buffer(), np.uint8).reshape(features, len(r)), r, w, u


def packed(df: DataFrame, columns: Sequence[str], target: str, cuts: list[np.ndarray], base: float, weight: Column | None = None) -> DataFrame:
    """What ``fit`` needs of all rows with a target, in chunks of fewer than 2 ``CHUNK`` rows."""
    number = F.pmod(F.xxhash64(F.lit("row"), target, *columns), F.lit(PRIME))
    values = [F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)]
    weighted = weight is not None
    w = [weight.cast("double").alias("_w")] if weighted else []
    rows = df.where(F.col(target).isNotNull()).select(*values, (F.lit(base) - F.col(target).cast("double")).alias("_r"), number.alias("_u"), *w)

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        bins = np.zeros((len(cuts), t.num_rows), np.uint8)
        for i, cut in enumerate(cuts):
            reached = np.searchsorted(cut, t[i].to_numpy(), "right")
            bins[i] = np.where(t[i].is_null().to_numpy(), 0, reached)
        return _chunk(bins, t["_r"].to_numpy(), t["_w"].to_numpy() if weighted else np.zeros(0), t["_u"].to_numpy().astype(np.uint32))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for p in (whole.slice(i, CHUNK) for whole in parts for i in range(0, whole.num_rows, CHUNK)):
            held.append(p)
            n += p.num_rows
            if n >= CHUNK:
                yield chunk(held)
                held, n = [], 0
        if n:
            yield chunk(held)

    return rows.mapInArrow(run, CHUNKS)


def _grown(residual: np.ndarray, bins: np.ndarray, trees: list[tuple[list, np.ndarray]]) -> np.ndarray:
    """Residuals after the trees: splits and the nodes' values of each."""
    for splits, values in trees:
        residual = residual + values[_place(splits, bins)]
    return residual


def _histograms(chunks: DataFrame, features: int, usable: list[int], trees: list, splits: list, open_: list[int], line: tuple[int, int, int]) -> DataFrame:
    """_node, _f, _b, g, h: gradients and weights of the tree's sample in its open nodes, per usable feature and bin."""
    a, b, c = line
    width = BINS + 1
    code = np.full(max(open_) + 1, len(open_))
    code[open_] = np.arange(len(open_))
    # nodes that are finished, of however large a number, are none of the open ones
    code = np.r_[code, np.full(max([0, *(s[3] + 1 for s in splits)]) + 1, len(open_))]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(usable), (len(open_) + 1) * width))
        for p in parts:
            for bins, r, w, u in _chunks(p, features):
                taken = (u.astype(np.int64) * a + b) % PRIME < c
                cell = np.where(taken, code[_place(splits, bins)], len(open_)) * width
                r = _grown(r, bins, trees)
                g = r * w if len(w) else r
                for i, f in enumerate(usable):
                    at = cell + bins[f]
                    sums[0, i] += np.bincount(at, g, sums.shape[2])
                    sums[1, i] += np.bincount(at, w if len(w) else None, sums.shape[2])
        g, h = sums.reshape(2, len(usable), len(open_) + 1, width)[:, :, :-1]
        i, k, bin_ = np.nonzero((g != 0) | (h != 0))
        yield pa.RecordBatch.from_pydict({"_node": pa.array(np.array(open_)[k], pa.int32()), "_f": pa.array(np.array(usable)[i], pa.int32()), "_b": pa.array(bin_, pa.int32()), "g": g[i, k, bin_], "h": h[i, k, bin_]})

    parts = chunks.mapInArrow(run, "_node int, _f int, _b int, g double, h double")
    return parts.groupBy("_node", "_f", "_b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def fit(df: DataFrame, columns: Sequence[str], target: str, settings: Boosting | None = None, weight: Column | None = None, cuts: list[np.ndarray] | None = None) -> Model:
    """Fits on all rows of df with a target. The driver sees sums per node, feature and bin only.

    Every row carries its residual (margin less target), to which the trees since its last writing are added; they are written
    anew now and then, so that no pass grows with the model.
    """
    s = settings or Boosting()
    labelled = df.where(F.col(target).isNotNull())
    cuts = cuts_of(labelled, columns) if cuts is None else cuts
    w = weight if weight is not None else F.lit(1.0)
    base = labelled.agg((F.sum(F.col(target).cast("double") * w) / F.sum(w)).alias("b")).first().b
    model = Model(float(base or 0.0))
    chunks = materialize(packed(df, columns, target, cuts, model.base, weight), "boost")
    trees: list[tuple[list, np.ndarray]] = []  # grown since the chunks were written
    for tree in range(s.trees):
        usable, line = _columns(columns, s, tree), _line(s, tree)

        def histogram(nodes, open_, chunks=chunks, trees=tuple(trees), usable=usable, line=line):
            out = {k: (np.zeros((len(columns), BINS + 1)), np.zeros((len(columns), BINS + 1))) for k in open_}
            for r in _histograms(chunks, len(columns), usable, list(trees), _splits(nodes, columns, cuts), open_, line).collect():
                out[r._node][0][r._f, r._b], out[r._node][1][r._f, r._b] = r.g, r.h
            return out

        nodes = _grow(histogram, columns, cuts, s, tree)
        model.nodes += nodes
        trees.append((_splits(nodes, columns, cuts), np.array([r[6] or 0.0 for r in nodes])))
        if (tree + 1) % REWRITE == 0 and tree + 1 < s.trees:
            written, grown, features = chunks, list(trees), len(columns)

            def advance(parts: Iterator[pa.RecordBatch], grown=grown, features=features) -> Iterator[pa.RecordBatch]:
                for p in parts:
                    for bins, r, w, u in _chunks(p, features):
                        yield _chunk(bins, _grown(r, bins, grown), w, u)

            chunks, trees = materialize(written.mapInArrow(advance, CHUNKS), "boost"), []
            discard(written)
    discard(chunks)
    return model


def fit_arrays(x: np.ndarray, y: np.ndarray, w: np.ndarray, bins: np.ndarray, u: np.ndarray, columns: Sequence[str], cuts: list[np.ndarray], settings: Boosting | None = None) -> Model:
    """The same in memory: values, targets, weights, bins and numbers of the rows as ``prepared`` gives them."""
    s = settings or Boosting()
    model = Model(float((y * w).sum() / w.sum()) if len(y) else 0.0)
    margin = np.full(len(y), model.base)
    by = dict(zip(columns, x.T, strict=True))
    size = len(columns) * (BINS + 1)
    for tree in range(s.trees):
        a, b, c = _line(s, tree)
        taken = (u * a + b) % PRIME < c

        def histogram(nodes, open_, taken=taken, margin=margin):
            known, at = {r[1]: r for r in nodes}, np.zeros(len(y), int)
            for k in sorted(known):
                r = known[k]
                here = at == k
                at[here] = -1 if r[2] is None else np.where(by[r[2]][here] >= r[3], r[5], r[4])
            g, out = w * (margin - y), {}
            for k in open_:
                rows = taken & (at == k)
                cell = bins[rows] + np.arange(len(columns)) * (BINS + 1)
                out[k] = tuple(np.bincount(cell.ravel(), np.repeat(v[rows], len(columns)), size).reshape(len(columns), BINS + 1) for v in (g, w))
            return out

        nodes = _grow(histogram, columns, cuts, s, tree)
        model.nodes += nodes
        margin = margin + Model(0.0, nodes).predict(by) if len(y) else margin
    return model


def cross_validate(df: DataFrame, columns: Sequence[str], target: str, settings: Sequence[Boosting], fold: str = "fold", weighted: bool = True, local_rows: int | None = None) -> DataFrame:
    """One row a (setting, fold): errors on the fold of a model fitted on the others. Thresholds are those of all rows.

    Up to ``local_rows`` rows are sent to one task a (setting, fold), with the folds' common bins and numbers; more are
    fitted by Spark, fold by fold. Both grow the same trees.
    """
    labelled = df.where(F.col(target).isNotNull())
    cuts = cuts_of(labelled, columns)
    w = lambda s: sample_weight(target, s) if weighted else None
    k = [r[0] for r in labelled.select(fold).distinct().orderBy(fold).collect()]
    most = LOCAL_ROWS if local_rows is None else local_rows
    if labelled.limit(most + 1).count() > most:
        from pulsegrid.operators.evaluate import metrics

        parts = []
        for i, s in enumerate(settings):
            for f in k:
                model = fit(labelled.where(F.col(fold) != f), columns, target, s, w(s), cuts)
                scored = labelled.where(F.col(fold) == f).withColumn("_p", score_expression(model.nodes, model.base))
                parts.append(metrics(scored, target, "_p").select(F.lit(i).alias("setting"), F.lit(f).cast("int").alias("fold"), "n", "mae", "rmse", "r2"))
        return reduce(DataFrame.unionByName, parts)
    given = [Boosting(**asdict(s)) for s in settings]
    rows = prepared(labelled, columns, target, cuts, keep=[fold]).withColumnRenamed(fold, "_fold")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        i, f = key
        s, test = given[i], (part["_fold"] == f).to_numpy()
        x, y, u = part[list(columns)].to_numpy(float), part["_y"].to_numpy(float), part["_u"].to_numpy(np.int64)
        bins = np.stack(part["_bins"].tolist()).astype(np.int64)
        w = np.where(y >= s.high_value, s.high_weight, 1.0) if weighted else np.ones(len(y))
        model = fit_arrays(x[~test], y[~test], w[~test], bins[~test], u[~test], columns, cuts, s)
        e = y[test] - model.predict(dict(zip(columns, x[test].T, strict=True)))
        spread = ((y[test] - y[test].mean()) ** 2).sum()
        r2 = 1 - (e**2).sum() / spread if len(e) > 1 and spread > 0 else None
        return pd.DataFrame({"setting": [i], "fold": [f], "n": [len(e)], "mae": [np.abs(e).mean()], "rmse": [np.sqrt((e**2).mean())], "r2": [r2]})

    tasks = F.explode(F.array(*[F.struct(F.lit(i).alias("setting"), F.lit(f).cast("int").alias("fold")) for i in range(len(given)) for f in k]))
    spread = rows.withColumn("_task", tasks).select("*", "_task.setting", "_task.fold").drop("_task")
    return spread.groupBy("setting", "fold").applyInPandas(run, "setting int, fold int, n long, mae double, rmse double, r2 double")


def sweep(df: DataFrame, columns: Sequence[str], target: str, parameter: str, values: Sequence[float], settings: Boosting | None = None, fold: str = "fold") -> DataFrame:
    """Mean errors over the folds per value of one parameter (unweighted); ``best`` marks the smallest MAE."""
    base = asdict(settings or Boosting())
    name = {k.lower(): k for k in base}[parameter.lower()]
    scores = cross_validate(df, columns, target, [Boosting(**base | {name: v}) for v in values], fold, weighted=False)
    each = scores.groupBy("setting").agg(F.avg("mae").alias("mae"), F.stddev_pop("mae").alias("mae_std"), F.avg("rmse").alias("rmse"))
    best = each.agg(F.min_by("setting", F.struct("mae", "setting")).alias("_best"))
    value = F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("setting"))
    return each.crossJoin(F.broadcast(best)).select(value.alias("value"), "mae", "mae_std", "rmse", (F.col("setting") == F.col("_best")).alias("best"))


def learning_curve(df: DataFrame, columns: Sequence[str], target: str, settings: Boosting | None = None, fold: str = "fold", points: int = 10) -> DataFrame:
    """Mean fold errors (unweighted) of fits on growing shares of the rows, taken in hash order."""
    share = F.pmod(F.xxhash64(F.lit("curve"), target, *columns), F.lit(1000))
    out = None
    for i in range(1, points + 1):
        part = df.where(share < 1000 * i // points)
        row = cross_validate(part, columns, target, [settings or Boosting()], fold, weighted=False).agg(F.lit(i / points).alias("share"), F.sum("n").alias("n"), F.avg("mae").alias("mae"), F.stddev_pop("mae").alias("mae_std"))
        out = row if out is None else out.unionByName(row)
    return out
