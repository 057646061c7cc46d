"""Merkle manifest of a dataset: contiguous numpy digest matrices, one tree a group (a source) and one over the groups.

A leaf is the hash of a row's fields. The leaves of a group stand in the order of their key, and every ``FANOUT``
consecutive nodes become the hash of their digests' hex text until one is left, the group's subroot; the subroots, in the
order of the groups, become the root in the same way.

Positions come from one range sort of the digests (never of the texts). They cut a group into aligned blocks of
``FANOUT ** LEVELS`` nodes, so a group with a third of all rows is many tasks' work. Inside a block the hex digests are one
(n, 64) matrix: its rows, taken ``FANOUT`` at a time, are hashed level by level, and the siblings of every leaf at every level
are looked up in these matrices by index arithmetic. The nodes above the blocks are few and are cut into blocks again. The way
down repeats it: every node gets its path, the siblings up to the root, from the path of its block.

Defined results: a null field is hashed as ``-``, which no value's form equals; null groups come first, as do null keys in
a group; rows with one key stand in the order of their leaves, so repeated rows are leaves side by side whatever the
partitioning; empty texts are fields of length 0; an empty table gives an empty manifest; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.llm.common import forget, materialize, null_safe

FANOUT = 3
#: Levels of a block: 729 nodes.
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(fields: Sequence[Column | str]) -> Column:
    """The hex digest of a row: each field as its byte count, a colon and its value, or ``-`` where it is null."""
    parts = []
    for c in fields:
        s = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """rows, written, with ``_pos``: the place in the group ``_g`` (not null) by ``order``.

    After a range sort a group lies in consecutive partitions, and at most one group of each partition began in an earlier one:
    the table of offsets has no more rows than there are partitions, whatever the input, so it is broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            g = b.column("_g")
            new = np.concatenate([[g[0].as_py() != last], pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)]).astype(bool)
            at = np.arange(n)
            rank = at - np.maximum.accumulate(np.where(new, at, 0)) + np.where(np.cumsum(new) == 0, seen, 0)
            last, seen = g[n - 1].as_py(), int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rank, pa.int64()), pa.array(np.full(n, part), pa.int32())], [*b.schema.names, "_rank", "_part"])

    by = ["_g", *order]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    ranked = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, f"{schema}, _rank bigint, _part int"), name)
    pieces = ranked.groupBy("_g", "_part").agg((F.max("_rank") + 1).alias("_n"))
    earlier = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.withColumn("_before", F.sum("_n").over(earlier)).where("_before > 0").select("_g", "_part", "_before")
    out = ranked.join(F.broadcast(offsets), ["_g", "_part"], "left")
    out = out.withColumn("_pos", F.col("_rank") + F.coalesce("_before", F.lit(0))).drop("_rank", "_part", "_before")
    out._written_at = ranked._written_at
    return out


def _blocks(rows: DataFrame, function, schema: str) -> DataFrame:
    """function(group, block, rows of the block by ``_pos`` as an Arrow table) for each block; its batches are the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from function(t.column("_g")[0].as_py(), t.column("_block")[0].as_py(), t)

        for b in batches:
            g, k, n = b.column("_g"), b.column("_block"), b.num_rows
            if not n:
                continue
            if held and (held[-1].column("_g")[-1], held[-1].column("_block")[-1]) != (g[0], k[0]):
                yield from whole()
                held = []
            ends = pc.or_(pc.not_equal(g[1:], g[:-1]), pc.not_equal(k[1:], k[:-1])).to_numpy(zero_copy_only=False)
            start = 0
            for end in (np.flatnonzero(ends) + 1).tolist():
                held.append(b.slice(start, end - start))
                yield from whole()
                held, start = [], end
            held.append(b.slice(start))
        if held:
            yield from whole()

    return rows.repartition("_g", "_block").sortWithinPartitions("_g", "_block", "_pos").mapInArrow(run, schema)


def _matrix(digests: pa.Array) -> np.ndarray:
    """The hex text of binary digests, (n, 64)."""
    return np.frombuffer(b"".join(digests.to_pylist()).hex().encode(), np.uint8).reshape(-1, 64)


def _hashed(rows: np.ndarray, members: np.ndarray) -> np.ndarray:
    """The digests of the rows of a (n, fanout, 64) matrix; of a row count the first ``members`` nodes."""
    raw, width = rows.tobytes(), FANOUT * 64
    return np.frombuffer("".join(sha256(raw[i * width : i * width + m * 64]).hexdigest() for i, m in enumerate(members.tolist())).encode(), np.uint8).reshape(-1, 64)


def _runs(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """nodes as (runs, fanout, 64), the last run filled up, and how many nodes each run has."""
    runs = -(-len(nodes) // FANOUT)
    full = np.zeros((runs * FANOUT, 64), np.uint8)
    full[: len(nodes)] = nodes
    return full.reshape(runs, FANOUT, 64), np.minimum(len(nodes) - FANOUT * np.arange(runs), FANOUT)


def _levels(nodes: np.ndarray, block: int, height: int) -> list[np.ndarray]:
    """The matrices of a block, level by level, up to its top node. Only a group's single block may end below ``height``."""
    out = [nodes]
    while len(out[-1]) > 1 or (block and len(out) <= height):
        out.append(_hashed(*_runs(out[-1])))
    return out


def _siblings(levels: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For every leaf of the block, level by level: the nodes of its run (n, fanout, 64), how many they are, its own place."""
    at = np.arange(len(levels[0]))
    for nodes in levels[:-1]:
        runs, members = _runs(nodes)
        yield runs[at // FANOUT], members[at // FANOUT], at % FANOUT
        at = at // FANOUT


def _up(nodes: DataFrame, height: int) -> DataFrame:
    """The top node of each block (_g, _pos, _digest)."""

    def top(group: str, block: int, t: pa.Table) -> Iterator[pa.RecordBatch]:
        digest = bytes.fromhex(_levels(_matrix(t.column("_digest").combine_chunks()), block, height)[-1].tobytes().decode())
        yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([block], pa.int64()), pa.array([digest], pa.binary())], ["_g", "_pos", "_digest"])

    rows = nodes.select("_g", (F.col("_pos") / FANOUT**height).cast("long").alias("_block"), "_pos", "_digest")
    return _blocks(rows, top, "_g string, _pos bigint, _digest binary")


def _climb(nodes: DataFrame, height: int, name: str) -> list[DataFrame]:
    """The written tables of block nodes above ``nodes``, until each group has one node."""
    out = [materialize(_up(nodes, height), name)]
    while (out[-1].agg(F.max("_pos")).first()[0] or 0) > 0:
        out.append(materialize(_up(out[-1], height), name))
    return out


def _below(nodes: DataFrame, paths: DataFrame, height: int, carried: Sequence[str], function, schema: str) -> DataFrame:
    """function for each block of nodes, whose first row (``_pos`` -1) has the ``_path`` of the block and its subroot."""
    kinds = dict(nodes.dtypes)
    rows = nodes.select("_g", (F.col("_pos") / FANOUT**height).cast("long").alias("_block"), "_pos", "_digest", *carried, F.lit(None).cast("string").alias("_path"), F.lit(None).cast("binary").alias("_subroot"))
    of_block = paths.select("_g", F.col("_pos").alias("_block"), F.lit(-1).cast("long").alias("_pos"), F.lit(None).cast("binary").alias("_digest"), *[F.lit(None).cast(kinds[c]).alias(c) for c in carried], "_path", "_subroot")
    return _blocks(rows.unionByName(of_block), function, schema)


def _path_of(levels: list[np.ndarray], above: str) -> list[str]:
    """A path: for each level the node's place in its run and its siblings' digests; the levels end with a slash."""
    out = [""] * len(levels[0])
    for runs, members, place in _siblings(levels):
        for i, (m, p) in enumerate(zip(members.tolist(), place.tolist(), strict=True)):
            own = runs[i].tobytes()
            out[i] += f"{p}{own[: p * 64].decode()}{own[(p + 1) * 64 : m * 64].decode()}/"
    return [x + above for x in out]


def _folded(digest: str, path: str) -> str:
    for level in path.split("/")[:-1]:
        p = 1 + 64 * int(level[0])
        digest = sha256(f"{level[1:p]}{digest}{level[p:]}".encode()).hexdigest()
    return digest


def _descend(nodes: DataFrame, paths: DataFrame, height: int, name: str | None = None) -> DataFrame:
    """The path and the subroot of every node; name: a column to carry."""

    def paths_of(group: str, block: int, t: pa.Table) -> Iterator[pa.RecordBatch]:
        t, above = t.slice(1), t.slice(0, 1)
        found = _path_of(_levels(_matrix(t.column("_digest").combine_chunks()), block, height), above.column("_path")[0].as_py())
        subroot = t.column("_digest").combine_chunks() if name else pa.array([above.column("_subroot")[0].as_py()] * len(found), pa.binary())
        groups = t.column(name).combine_chunks() if name else pa.array([group] * len(found), pa.string())
        at = pa.array(np.zeros(len(found)), pa.int64()) if name else t.column("_pos").combine_chunks()
        yield pa.RecordBatch.from_arrays([groups, at, pa.array(found, pa.string()), subroot], ["_g", "_pos", "_path", "_subroot"])

    return _below(nodes, paths, height, [name] if name else [], paths_of, "_g string, _pos bigint, _path string, _subroot binary")


def manifest(docs: DataFrame, claimed: Column | None = None, key: str = "doc_id", group: str = "source", fields: Sequence[str] = FIELDS, height: int = LEVELS) -> DataFrame:
    """One row a row of docs: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    claimed: the ``leaf`` that a holder of the row would compute (null: the row's own); folded_root is computed from it and the
    row's siblings, and verified says whether that is the root. height: levels of a block, which changes no result.
    """
    digests = docs.select(
        F.col(key).alias("_key"), null_safe(group).alias("_g"), F.unhex(leaf(fields)).alias("_digest"), F.unhex(F.lit(None).cast("string") if claimed is None else claimed).alias("_claimed"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    digests = materialize(digests, "leaves")
    leaves = _numbered(digests, ["_key", "_digest", "_tie"], "numbered").drop("_tie")
    forget(digests)
    levels = _climb(leaves, height, "blocks")
    subroots = levels[-1].select(F.lit("").alias("_g"), F.col("_g").alias("_name"), "_digest")
    above = _numbered(subroots, ["_name"], "subroots")
    top = _climb(above, height, "tops")
    root_row = top[-1].first()
    root = root_row._digest.hex() if root_row else ""
    paths = top[-1].select("_g", "_pos", F.lit("").alias("_path"), F.col("_digest").alias("_subroot"))
    for nodes in reversed(top[:-1]):
        paths = _descend(nodes, paths, height)
    paths = _descend(above, paths, height, "_name")
    for nodes in reversed(levels[:-1]):
        paths = _descend(nodes, paths, height)

    def proofs(_: str, block: int, t: pa.Table) -> Iterator[pa.RecordBatch]:
        above_, t = t.slice(0, 1), t.slice(1)
        path, subroot = above_.column("_path")[0].as_py(), above_.column("_subroot")[0].as_py().hex()
        own = t.column("_digest").combine_chunks()
        nodes, n = _matrix(own), len(own)
        steps = list(_siblings(_levels(nodes, block, height)))
        rest = "".join(x[1:] for x in path.split("/")).encode()
        siblings = [b""] * n
        if steps:
            where = np.arange(FANOUT)
            others = np.stack([(where < m[:, None]) & (where != p[:, None]) for _, m, p in steps], 1)  # (n, levels, fanout)
            flat = np.stack([runs for runs, _, _ in steps], 1)[others].tobytes()
            ends = np.cumsum(others.sum((1, 2))) * 64
            siblings = [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        now = _matrix(pc.coalesce(t.column("_claimed").combine_chunks(), own))
        for runs, members, place in steps:
            runs = runs.copy()
            runs[np.arange(n), place] = now
            now = _hashed(runs, members)
        tops = [x.tobytes().decode() for x in now]
        of_top = {x: _folded(x, path) for x in set(tops)}
        folded = [of_top[x] for x in tops]
        proof = [sha256(x + rest).hexdigest() for x in siblings]
        columns = [pa.array([x.tobytes().decode() for x in nodes]), pa.array([subroot] * n), pa.array([root] * n), pa.array(proof), pa.array(folded), pa.array([x == root for x in folded])]
        yield pa.RecordBatch.from_arrays([t.column("_key").combine_chunks(), *columns], ["_key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    kind = docs.schema[key].dataType.simpleString()
    out = _below(leaves, paths, height, ["_key", "_claimed"], proofs, f"_key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumnRenamed("_key", key)
