"""The Jaccard join and the pipeline."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

from pulsegrid.llm import ngram_join


def words_of(text):
    return (text or "").encode().split()


def shingle_set(text):
    w = words_of(text)
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(texts):
    """Degrees and classes by comparing all pairs."""
    sets = [shingle_set(t) for t in texts]
    degree, parent = Counter(), list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and Fraction(both, len(sets[i] | sets[j])) >= Fraction(4, 5):
                degree[i] += 1
                degree[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return degree, [find(i) for i in range(len(texts))]


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in ngram_join.similar(df).collect()}
    degree, root = brute(texts)
    size = Counter(root)
    for i in range(len(texts)):
        assert (got[i].n_links, got[i].class_id, got[i].class_size) == (degree[i], root[i], size[root[i]]), i
    kept = sorted(r.doc_id for r in ngram_join.one_of_each(df).collect())
    assert kept == sorted(set(root))


def near(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
    return " ".join(w)


def test_join_by_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n", "one two", "one two", "one  two", "one two three four five", "a b c d e f"]
    for n, copies in ((40, 4), (150, 6), (400, 5), (2000, 3)):
        base = [f"w{rng.randrange(3000)}" for _ in range(n)]
        texts += [near(rng, base, rng.randrange(0, max(2, n // 30))) for _ in range(copies)]
    check(spark, texts)


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    """Blocks of five: a group of copies, a chain and a crowd that shares a passage all span several."""
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(base)] * 9 + [near(rng, base, rng.randrange(1, 5)) for _ in range(23)]
    texts += [passage + " " + " ".join(f"t{i}x{k}" for k in range(60)) for i in range(15)]
    chain = list(base)
    for i in range(14):
        chain[(i * 8) % 120] = f"c{i}"
        texts.append("q " + " ".join(chain))
    check(spark, texts)


def test_join_edges(edge, empty):
    rows = ngram_join.similar(edge).collect()
    assert len(rows) == edge.count() and ngram_join.similar(empty).count() == 0
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert {r.n_links for k in (1, 2) for r in by[k]} == {2} and {r.class_id for k in (1, 2) for r in by[k]} == {1}
    assert all(r.n_links == 0 and r.class_size == 1 for k in (3, 4, 5) for r in by[k])
    kept = ngram_join.one_of_each(edge)
    assert kept.columns == edge.columns and ngram_join.one_of_each(empty).count() == 0
    assert Counter(r.doc_id for r in kept.collect()) == Counter({1: 1, 3: 1, 4: 1, None: 2, 5: 1, 6: 1, 7: 1})
    twice = edge.where("doc_id = 2").unionByName(edge.where("doc_id = 2"))
    assert ngram_join.one_of_each(twice).count() == 1


def test_rows_without_words_all_stay(spark):
    rows = [(None, None, "a"), (None, None, "b"), (None, " ", "c"), (1, "", "d"), (1, "", "e"), (1, None, "f"), (2, "x y", "g"), (2, "x y", "h")]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r.source for r in kept)[:6] == list("abcdef") and len(kept) == 7


def test_columns_of_any_name_are_kept(spark):
    names = ["_jaccard_text", "_rows", "_kept", "_k", "_t", "_doc", "_tid"]
    rows = [(1, "x y z", *"abcdefg"), (1, "x y z", *"abcdefg"), (2, "x y z", *"hijklmn"), (3, "other words here", *"opqrstu")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    kept = sorted(tuple(r) for r in ngram_join.one_of_each(docs).collect())
    assert kept == [rows[0], rows[3]] and ngram_join.one_of_each(docs).columns == docs.columns


def test_repeated_rows_are_verified_once(spark, monkeypatch):
    base = [f"w{i}" for i in range(100)]
    rows = [(None, " ".join(base))] * 40 + [(3, " ".join(["n", *base[1:]]))]
    met, mapped = [], ngram_join.map_arrow
    monkeypatch.setattr(ngram_join, "map_arrow", lambda r, *a: (met.append(r.count()) if "_class" in r.columns else None) or mapped(r, *a))
    got = ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert met == [2] and {(r.doc_id, r.class_id, r.class_size, r.n_copies, r.n_links) for r in got} == {(None, 3, 41, 40, 40), (3, 3, 41, 1, 40)}


def test_families_meet_by_size(spark, monkeypatch):
    """A chain of texts that grow: links only between neighbours in size, blocks bounded by bytes, results exact."""
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 2000)
    words = [f"w{i}" for i in range(400)]
    check(spark, [" ".join(words[:n]) for n in range(60, 400, 9)] + [" ".join(words[:200])] * 3)


def test_pruning_keeps_what_may_reach_the_threshold():
    need = ngram_join.least_matches()
    assert need[0] == 0 and need[125] < 100 and all(a <= b for a, b in zip(need, need[1:]))


def test_pipeline(spark, sf_dir, documents):
    import corpus_pipeline

    docs, sizes = documents, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        sizes.append((name, out.count()))
        if name != "packing":
            assert out.columns == documents.columns
        if name in ("quality_classifier", "quality_rules", "near_duplicates"):
            assert out.exceptAll(docs).count() == 0
        if name == "near_duplicates":
            _, root = brute([r.text for r in docs.collect()])
            assert out.count() == len(set(root))
        docs = out
    assert sizes[0][1] > sizes[1][1] > sizes[2][1] and sizes[4][1] > 0
    assert corpus_pipeline.run(spark, sf_dir).agg({"length": "sum"}).first()[0] == docs.agg({"length": "sum"}).first()[0]
    empty = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
        assert empty.count() == 0
