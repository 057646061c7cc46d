"""The Merkle manifest against a recursive one and SQL."""

from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from pulsegrid.llm import merkle, queries


def digest(x):
    return sha256(x.encode()).hexdigest()


def leaf_of(*fields):
    return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def tree(nodes):
    """The top of nodes and, for each of them, its siblings with how many of them come before it, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for p, i in zip(paths, at, strict=True):
            run = runs[i // 3]
            p.append((run[: i % 3], run[i % 3 + 1 :]))
        nodes, at = [digest("".join(r)) for r in runs], [i // 3 for i in at]
    return nodes[0], paths


def brute(rows, claimed):
    groups = defaultdict(list)
    for r in rows:
        groups[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf_of(r.doc_id, r.source, r.lang, r.n_chars, r.text), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    inner = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        inner[g] = tree([x[2] for x in groups[g]])
    root, above = tree([inner[g][0] for g in order])
    out = Counter()
    for g, up in zip(order, above, strict=True):
        for (_, _, leaf, r), path in zip(groups[g], inner[g][1], strict=True):
            now = claimed(r) or leaf
            for a, b in path + up:
                now = digest("".join([*a, now, *b]))
            out[r.doc_id, leaf, inner[g][0], root, digest("".join("".join(a + b) for a, b in path + up)), now, now == root] += 1
    return out


def test_manifest_equals_sql(spark, sf_dir):
    assert differences(queries.op11_merkle_manifest(spark, sf_dir), connect(sf_dir), queries.oracle_sql()["op11_merkle_manifest"]) == ([], [])


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_by_brute_force(edge, documents, empty, height):
    docs = edge.drop("_row", "_h").unionByName(documents.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id < 120"))
    other = F.when(F.col("doc_id") % 3 == 0, merkle.leaf([F.lit("x") if c == "text" else c for c in merkle.FIELDS]))
    got = Counter(tuple(r) for r in merkle.manifest(docs.repartition(5), other, height=height).collect())
    want = brute(docs.collect(), lambda r: leaf_of(r.doc_id, r.source, r.lang, r.n_chars, "x") if r.doc_id is not None and r.doc_id % 3 == 0 else None)
    assert got == want
    assert merkle.manifest(empty, height=height).count() == 0


def test_manifest_of_one_group(spark):
    """Every size around the powers of the fanout, in blocks of three."""
    for n in (1, 2, 3, 4, 9, 10, 27, 28):
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("t").alias("text"))
        assert Counter(tuple(r) for r in merkle.manifest(docs, height=1).collect()) == brute(docs.collect(), lambda r: None)
