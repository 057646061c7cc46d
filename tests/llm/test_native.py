"""Quality rules, sharding and mixing."""

import zlib
from collections import Counter, defaultdict

from oracle import connect, differences
from pyspark.sql import functions as F

from pulsegrid.llm import mixing, queries, quality_rules, sharding
from pulsegrid.llm.common import _with_least, components, running_total


def test_rules_equal_sql(spark, sf_dir):
    sql = queries.oracle_sql()["op1_quality_rules"]
    assert differences(queries.op1_quality_rules(spark, sf_dir), connect(sf_dir), sql) == ([], [])


def brute(text):
    w = [x.decode() for x in (text or "").encode().split()]
    c = Counter(zip(w, w[1:], w[2:]))
    at = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), len(lines) - len(set(lines)), len(at)


def test_rules_by_brute_force(edge, empty):
    rows = quality_rules.quality_rules(edge).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == Counter((r.doc_id, *brute(r.text)) for r in edge.collect())
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) for r in rows)
    assert quality_rules.quality_rules(empty).count() == 0
    assert [r.doc_id for r in quality_rules.keep(edge).collect()] == [6]
    assert quality_rules.keep(edge).columns == edge.columns and quality_rules.keep(empty).count() == 0


def test_length_alone_rejects_nothing(spark):
    text = "\n".join(" ".join(f"plainword{i}" for i in range(k, k + 20)) for k in range(0, 1_000_020, 20))
    row = quality_rules.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_words == 1_000_020 and row.fail_bits == quality_rules.BITS["too_many_words"] and row.kept and row.policy == "web/2"


def test_repeats_are_found_whatever_the_hash_bits(spark, monkeypatch):
    """With one hash for all windows every run holds foreign windows between equal ones; the counts stay exact."""
    texts = ["a b c x a b c y a b c", "p q r s t u p q r s t u v w", "a b a b a b a b", "one two three four"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expr = F.expr
    monkeypatch.setattr(quality_rules.F, "expr", lambda e: expr(e.replace("xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2))", "1L")))
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.measurements(rows).collect()}
    assert got == {i: brute(t)[4] for i, t in enumerate(texts)}


def test_ablations(documents):
    rows = quality_rules.ledger(documents).cache()
    policy = quality_rules.Policy("two", 1, ("few_words", "shouting"))
    got = {r.rule: r for r in quality_rules.ablations(rows, policy).collect()}
    few, loud = "n_words < 50", "2 * n_upper > n_letters"
    assert got["few_words"].n_failed == rows.where(few).count()
    assert got["few_words"].n_only == rows.where(f"{few} AND NOT {loud}").count()
    assert got["shouting"].n_kept_without == rows.where(f"NOT {few}").count()


def test_shards(edge, empty, documents):
    tree = sharding.even_tree(8)
    for docs in (edge, documents):
        rows = sharding.shard(docs, tree).collect()
        assert len(rows) == docs.count()
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
            assert r.grown_shard in (r.shard, 8)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = {r.doc_id: r.text for r in documents.collect()}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id].encode()) + 1 for r in rows)
    assert len(slots) == 8 and sharding.shard(empty, tree).count() == 0


def test_weights_confine_movement(spark):
    ids = spark.range(20_000)
    tree = [sharding.Shard(i // 4, i // 2, i, 1.0 + i % 3) for i in range(8)]
    other = [*tree[:7], sharding.Shard(1, 3, 7, 6.0)]
    k = F.col("id").cast("string")
    rows = ids.select(sharding.place(k, tree).alias("a"), sharding.place(k, other).alias("b")).groupBy("a", "b").count().collect()
    share = Counter()
    for r in rows:
        share[r.a] += r["count"]
        if r.a != r.b:
            assert r.b >= 4  # only into the region whose weight grew; inside it only to the shard or anew
    total = sum(s.weight for s in tree)
    assert all(abs(share[s.shard] / 20_000 - s.weight / total) < 0.02 for s in tree)


def water(sizes, weights, share, epochs):
    budget, target, open_ = share * sum(sizes.values()), {}, set(sizes)
    while open_:
        w = sum(weights[s] for s in open_)
        full = {s for s in open_ if epochs * sizes[s] <= budget * weights[s] / w}
        if not full:
            return target | {s: budget * weights[s] / w for s in open_}
        s = min(full, key=lambda s: epochs * sizes[s] / weights[s])
        target[s] = epochs * sizes[s]
        budget -= target[s]
        open_.remove(s)
    return target


def test_mix(documents, edge, empty):
    for docs in (documents, edge):
        rows = mixing.mix(docs).collect()
        assert len(rows) == docs.count()
        source = {r.doc_id: r.source for r in docs.collect()} if docs is documents else None
        assert sum(r.taken for r in rows) == int(1.5 * sum(r.size for r in rows))
        assert all(0 <= r.taken <= 2 * r.size for r in rows)
        if source:
            sizes = Counter()
            for r in rows:
                sizes[source[r.doc_id]] += r.size
            weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
            want = water(sizes, weights, 1.5, 2)
            taken = Counter()
            for r in rows:
                taken[source[r.doc_id]] += r.taken
                assert abs(r.target - want[source[r.doc_id]]) < 1e-6
            most = max(r.size for r in rows)
            assert all(abs(taken[s] - want[s]) <= 2 * most for s in sizes)
            again = Counter((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(3)).collect())
            assert again == Counter((r.doc_id, r.taken) for r in rows)
    assert mixing.mix(empty).count() == 0
    m = mixing.mixed(documents)
    clash = edge.withColumnsRenamed({"_row": "_times", "_h": "_epoch"}).withColumn("_id", F.lit(1)).withColumn("_mix_row", F.lit(2))
    assert mixing.mixed(clash, copy="copy").columns == [*clash.columns, "copy"] and mixing.mixed(clash).count() == mixing.mixed(edge).count()
    blank = edge.withColumn("text", F.lit(" "))
    assert {(r.size, r.taken) for r in mixing.mix(blank).collect()} == {(0, 0)}
    assert m.columns == documents.columns and m.count() == sum(-(-r.taken // r.size) for r in mixing.mix(documents).collect() if r.taken)


def test_running_total(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("h"), "id")
    rows = running_total(df, ["k"], "h", ["id"], F.col("id"), "before").collect()
    seen = Counter()
    for r in sorted(rows, key=lambda r: r.h):
        assert r.before == seen[r.k]
        seen[r.k] += r.id


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 150: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hubs_of_components_are_split(spark):
    """One class of 100 000 nodes around a hub: its links are not dealt by the hub, so no task holds them all."""
    star = spark.range(1, 100_000).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    chain = spark.range(200_000, 200_050).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(star.unionByName(chain)).groupBy("comp").count().collect()
    assert {(r.comp, r["count"]) for r in got} == {(0, 100_000), (200_000, 51)}
    both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rows = _with_least(both.where("a = 0"), both, 100_000)
    assert rows.count() == 99_999 and rows.select("m").distinct().collect()[0].m == 1
    # the hub's rows come from the broadcast side of the union alone
    assert rows.where("m <> 1").count() == 0 and "BroadcastHashJoin" in rows._jdf.queryExecution().executedPlan().toString()
