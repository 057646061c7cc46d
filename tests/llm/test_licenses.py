"""License scans against SQL, a plain search of phrases and planted notices."""

import re

from oracle import connect, differences

from pulsegrid.llm import queries
from pulsegrid.llm.license_scan import PHRASES, TEMPLATES, license_scan, license_spans

BODY = {t.label: t.text for t in TEMPLATES if len(t.text.split()) > 20}


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in license_scan(docs).collect()}


def test_equals_sql(spark, sf_dir):
    assert differences(queries.op12_license_scan(spark, sf_dir), connect(sf_dir), queries.oracle_sql()["op12_license_scan"]) == ([], [])


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_base_by_brute_force(spark, edge, empty, documents):
    own = ["Under the MIT license", "the mit license", "CC BY-NC, cc/by/nc; cc by nc", "apache license version 2.0 under THE MIT\nlicense", "ÀCC BY NC", "cc_by nc \x00 cc\x7fby{nc"]
    docs = edge.select("doc_id", "text").unionByName(documents.select("doc_id", "text")).unionByName(spark.createDataFrame(list(enumerate(own, 10**6)), "doc_id long, text string"))
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan(docs).collect())
    want = []
    for r in docs.collect():
        w = words(r.text)
        places = [(i, label) for p, label in PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        want.append((str(r.doc_id), len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert license_scan(empty).count() == 0


def test_planted_notices(spark):
    filler = " " + "ein anderer satz über nichts " * 30
    mit, bsd = BODY["mit"], BODY["bsd"]
    edited = mit.split()
    edited[20:20] = ["new", "word"]
    del edited[60:62]
    edited[80] = "changed"
    texts = [
        filler + mit.upper() + filler,
        filler + " ".join(edited) + filler,  # words inserted, left out and changed
        filler + " ".join(mit.split()[:60]) + filler,  # less than the share
        "Licensed under the GNU Lesser General Public License, version 3",
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
        "the rights of the software and the terms of the public of the license " * 50,
        mit + " " + filler + bsd + " " + filler + mit,
        ("Licensed under CC BY-SA. " * 400) + filler,
        filler,
    ]
    got = scanned(spark, texts)
    assert [got[i].labels for i in range(10)] == ["mit", "mit", "", "lgpl", "gpl-3", "gpl-2", "", "bsd,mit", "cc-by-sa", ""]
    assert got[0].score == 1.0 and 0.75 <= got[1].score < 1.0 and got[9].score == 0.0 and got[2].score == 0.0
    assert got[7].n_spans == 3 and got[8].n_spans == 400
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = sorted((r.first_word, r.last_word, r.label) for r in license_spans(docs).where("doc_id = 7").collect())
    n, f, b = len(mit.split()), len(filler.split()), len(bsd.split())
    assert spans == [(0, n - 1, "mit"), (n + f, n + f + b - 1, "bsd"), (n + 2 * f + b, 2 * n + 2 * f + b - 1, "mit")]


def test_no_python_in_the_plan(spark, sf_dir):
    plan = queries.op12_license_scan(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)
