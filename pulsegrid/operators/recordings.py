"""Filters over whole recordings of any length, by a block scan of the filter's state.

A recursive filter is an affine map of its state: over a block of n samples the state becomes A^n x + b, where b is what the block
alone gives from rest. So blocks are run from rest by themselves, their maps are composed along a recording (some numbers a
block), and every block is given its true start state and its output. Inside a block samples go through matrices of
``STEP`` samples, not through a loop over samples. Results do not depend on the size of the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.shared import discard, materialize

#: Samples of a block, and of the matrices inside it.
BLOCK, STEP = 1 << 14, 128
#: Samples that go through the matrices together.
HELD = 1 << 20
#: The block of the extension behind a recording; the one before it is -1.
LAST = 1 << 62


@dataclass(frozen=True)
class StateSpace:
    """x' = A x + B v, y = C x + D v: second-order sections (b0 b1 b2 a1 a2) in a row."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float
    kept: dict = field(default_factory=dict, compare=False)  # matrices by their number of samples

    @classmethod
    def of(cls, sections: np.ndarray) -> StateSpace:
        a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
        for b0, b1, b2, a1, a2 in sections:
            own, drive = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
            a = np.block([[a, np.zeros((len(a), 2))], [np.outer(drive, c), own]])
            b, c, d = np.r_[b, drive * d], np.r_[b0 * c, 1.0, 0.0], b0 * d
        return cls(a, b, c, d)

    def steady(self) -> np.ndarray:
        """The state that a constant input of 1 leads to."""
        return np.linalg.solve(np.eye(len(self.a)) - self.a, self.b)

    def matrices(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Over n samples: output from the state and from the samples, end state from the state and from the samples."""
        if n in self.kept:
            return self.kept[n]
        powers = [np.eye(len(self.a))]
        for _ in range(n):
            powers.append(self.a @ powers[-1])
        response = np.array([self.d, *[self.c @ p @ self.b for p in powers[: n - 1]]])
        at = np.arange(n)[:, None] - np.arange(n)
        self.kept[n] = np.stack([self.c @ p for p in powers[:n]]), np.where(at >= 0, response[np.maximum(at, 0)], 0.0), powers[n], np.stack([powers[n - 1 - i] @ self.b for i in range(n)], 1)
        return self.kept[n]

    def run(self, v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output of the samples v (blocks, samples) from the states x (blocks, states), and the end states."""
        out, size = np.empty(v.shape), v.shape[1]
        for n, parts in ((STEP, range(0, size - STEP + 1, STEP)), (size % STEP, [size - size % STEP])):
            if not n:
                continue
            from_state, from_samples, carry, gain = self.matrices(n)
            for i in parts:
                out[:, i : i + n] = x @ from_state.T + v[:, i : i + n] @ from_samples.T
                x = x @ carry.T + v[:, i : i + n] @ gain.T
        return out, x


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of all lists one after the other, where each begins, and their lengths."""
    n = column.value_lengths().to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), np.cumsum(n) - n, n


def _as_lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(values))


def _stacks(part: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]]:
    """Slices of about ``HELD`` samples: the slice, per length its rows and their samples' places, all samples, lengths."""
    lengths = part.column("_v").value_lengths().to_numpy()
    group = np.cumsum(lengths) // HELD
    for begin, end in zip(np.r_[0, np.flatnonzero(np.diff(group)) + 1], np.r_[np.flatnonzero(np.diff(group)) + 1, len(group)], strict=True):
        same = part.slice(begin, end - begin)
        flat, at, n = _lists(same.column("_v"))
        rows = [np.flatnonzero(n == size) for size in np.unique(n)]
        yield same, [(r, at[r][:, None] + np.arange(n[r[0]])) for r in rows], flat, n


def _scan(blocks: DataFrame, space: StateSpace, backward: bool) -> DataFrame:
    """blocks (_key, _block, _v) with each _v filtered; backward: from the last sample of the last block to the first."""
    turn = -1 if backward else 1
    states = len(space.b)

    def ends(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for same, groups, flat, n in _stacks(part) if part.num_rows else ():
                first, end = np.empty(len(n)), np.empty((len(n), states))
                for rows, at in groups:
                    v = flat[at][:, ::turn]
                    first[rows], end[rows] = v[:, 0], space.run(v, np.zeros((len(rows), states)))[1]
                facts = [pa.array(n.astype(np.int64)), pa.array(first), _as_lists(end.ravel(), np.full(len(n), states))]
                yield pa.RecordBatch.from_arrays([same.column("_key"), same.column("_block"), *facts], ["_key", "_block", "_n", "_first", "_end"])

    def starts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady, powers, after = space.steady(), {}, np.zeros(states)
        for part in parts:
            if not part.num_rows:
                continue
            n, first, rank = (part.column(c).to_numpy() for c in ("_n", "_first", "_rank"))
            end = part.column("_end").flatten().to_numpy().reshape(-1, states)
            kinds, kind = np.unique(n, return_inverse=True)
            for k in kinds:
                if k not in powers:
                    powers[k] = np.linalg.matrix_power(space.a, int(k))
            maps = np.stack([powers[k] for k in kinds])
            x = np.where((rank == 1)[:, None], first[:, None] * steady, 0.0)
            # the first row may go on with the recording that the batch before ended with
            x[0] = x[0] if rank[0] == 1 else after
            begins = np.maximum.accumulate(np.where((rank == 1) | (np.arange(len(n)) == 0), np.arange(len(n)), 0))
            place = np.arange(len(n)) - begins
            order = np.argsort(place, kind="stable")
            bounds = np.searchsorted(place[order], np.arange(1, place.max() + 2))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):  # the second blocks of all recordings, then the third ones
                i = order[a:b]
                x[i] = np.einsum("rij,rj->ri", maps[kind[i - 1]], x[i - 1]) + end[i - 1]
            after = maps[kind[-1]] @ x[-1] + end[-1]
            yield pa.RecordBatch.from_arrays([part.column("_key"), part.column("_block"), _as_lists(x.ravel(), np.full(len(n), states))], ["_key", "_block", "_start"])

    def outputs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for same, groups, flat, n in _stacks(part) if part.num_rows else ():
                x, out = same.column("_start").flatten().to_numpy().reshape(-1, states), np.empty(len(flat))
                for rows, at in groups:
                    out[at] = space.run(flat[at][:, ::turn], x[rows])[0][:, ::turn]
                yield pa.RecordBatch.from_arrays([same.column("_key"), same.column("_block"), _as_lists(out, n)], ["_key", "_block", "_v"])

    kind = blocks.schema["_key"].dataType.simpleString()
    maps = blocks.mapInArrow(ends, f"_key {kind}, _block bigint, _n bigint, _first double, _end array<double>")
    along = Window.partitionBy("_key").orderBy(F.desc("_block") if backward else F.asc("_block"))
    begun = maps.withColumn("_rank", F.row_number().over(along).cast("long")).mapInArrow(starts, f"_key {kind}, _block bigint, _start array<double>")
    return blocks.join(begun, ["_key", "_block"]).mapInArrow(outputs, f"_key {kind}, _block bigint, _v array<double>")


def zero_phase(readings: DataFrame, sections: np.ndarray, channel: str = "ir", key: str = "subject_id", seq: str = "seq", block: int = BLOCK) -> DataFrame:
    """The channel filtered forward and backward over an odd extension at both ends: key, seq, channel.

    readings: samples numbered from 1 without gaps or missing values. A recording that is not longer than the extension cannot be
    filtered: its samples are NULL. The blocks are written on the way; what is composed for a recording has a row a block.
    """
    pad = 3 * (2 * len(sections) + 1)
    x = readings.select(F.col(key).alias("_key"), F.col(seq).cast("long").alias("_i"), F.col(channel).cast("double").alias("_x"))
    rows = x.withColumn("_block", F.floor((F.col("_i") - 1) / block).cast("long"))
    own = rows.groupBy("_key", "_block").agg(F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), F.col("_x").alias("x")))).alias("_p"))
    own = materialize(own.select("_key", "_block", F.col("_p.x").alias("_v")), "blocks")
    # a row a block from here on; only the samples next to an end are taken out of their blocks
    size = F.col("_block") * block + F.size("_v")
    facts = own.groupBy("_key").agg(F.max(size).alias("_n"), F.min_by(F.get("_v", F.lit(0)), "_block").alias("_x1"), F.max_by(F.element_at("_v", -1), "_block").alias("_xn"))
    known = own.join(facts, "_key")
    long = known.where(F.col("_n") > pad)
    near = long.where((F.col("_block") * block <= pad) | (size >= F.col("_n") - pad)).select("_key", "_block", "_n", "_x1", "_xn", F.posexplode("_v").alias("_at", "_x"))
    near = near.withColumn("_i", F.col("_block") * block + F.col("_at") + 1)
    piece = lambda at, i, x: F.struct(F.lit(at).cast("long").alias("block"), i.alias("i"), x.alias("x"))
    before = F.when(F.col("_i").between(2, pad + 1), piece(-1, 2 - F.col("_i"), 2 * F.col("_x1") - F.col("_x")))
    after = F.when(F.col("_i").between(F.col("_n") - pad, F.col("_n") - 1), piece(LAST, 2 * F.col("_n") - F.col("_i"), 2 * F.col("_xn") - F.col("_x")))
    beyond = near.select("_key", F.explode(F.array(before, after)).alias("p")).where("p IS NOT NULL")
    beyond = beyond.groupBy("_key", F.col("p.block").alias("_block")).agg(F.array_sort(F.collect_list(F.struct("p.i", "p.x"))).alias("_p")).select("_key", "_block", F.col("_p.x").alias("_v"))
    space = StateSpace.of(sections)
    extended = materialize(long.select("_key", "_block", "_v").unionByName(beyond), "extended")
    forward = materialize(_scan(extended, space, False), "forward")
    discard(extended)
    both = _scan(forward, space, True).where(F.col("_block").between(0, LAST - 1))
    short = known.where(F.col("_n") <= pad).select("_key", "_block", F.transform("_v", lambda _: F.lit(None).cast("double")).alias("_v"))
    out = both.unionByName(short).select("_key", "_block", F.posexplode("_v").alias("_at", "_y"))
    return out.select(F.col("_key").alias(key), (F.col("_block") * block + F.col("_at") + 1).alias(seq), F.col("_y").alias(channel))
