"""Alignment of tokens against a plain version that uses the libraries, byte by byte."""

from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm import queries, token_alignment
from pulsegrid.llm.token_alignment import Vocabularies, align, pair_counts, union_find


@pytest.fixture(scope="module")
def files():
    _, ranks, pattern = queries.byte_bpe()
    return Vocabularies(ranks, pattern, queries.vocabulary("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def encoders(files):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.byte_bpe()[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=files.pieces)


def byte_level():
    """The characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


OF = byte_level()


def plain(text, encoders):
    """Groups and links of one text, from its tokens' spans."""
    a, b = encoders
    if not text:
        return "", []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(OF[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, map(b.id_to_piece, ids_b), strict=True)]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return "", []
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    at_a, at_b = ({e: k + 1 for k, e in enumerate(ends)} for ends in (ends_a, ends_b))
    groups, links, i, j = [], [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        i2, j2 = at_a[end], at_b[end]
        groups.append(",".join(map(str, ids_a[i:i2])) + "|" + ",".join(map(str, ids_b[j:j2])))
        for x in range(i, i2):
            for y in range(j, j2):
                if max(ends_a[x] - len(bytes_a[x]), ends_b[y] - len(bytes_b[y])) < min(ends_a[x], ends_b[y]):
                    links.append((ids_a[x], ids_b[y]))
        i, j = i2, j2
    return ";".join(groups), links


def brute(rows, encoders):
    found = [(k, *plain(t, encoders)) for k, t in rows]
    count = Counter(p for _, _, links in found for p in set(links))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = Counter()
    for k, groups, links in found:
        sides = [g.split("|") for g in groups.split(";")] if groups else []
        n_a, n_b = (sum(len(g[s].split(",")) for g in sides) for s in (0, 1))
        out[k, n_a, n_b, len(sides), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha256(groups.encode()).hexdigest() if groups else "", groups] += 1
    return out, count


TEXTS = ["", "a", " ", "  two  spaces ", "new\nline\n\n\ttab", "▁ mark", "ﬁ ligature ½", "<|endoftext|> <s> </s> <unk>", "漢字かな交じり文", "🎉🎉 é", "x" * 5000, " " * 3000, "word\x00null", "ÀÉÎ straße", "<0x41>", "1234567890 $%^&"]


def test_alignment_by_brute_force(spark, edge, empty, documents, files, encoders):
    own = spark.createDataFrame(list(enumerate(TEXTS, 10_000)), "doc_id long, text string")
    docs = edge.select("doc_id", "text").unionByName(documents.select("doc_id", "text").where("doc_id < 60")).unionByName(own).repartition(3)
    want, count = brute([tuple(r) for r in docs.collect()], encoders)
    got = align(docs, files)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert {(r.a_id, r.b_id): r.n_docs for r in pair_counts(docs, files).collect()} == count
    assert align(empty, files).count() == 0 and pair_counts(empty, files).count() == 0


def test_chunks_change_nothing(spark, documents, files):
    docs = documents.select("doc_id", "text")
    one = align(docs.coalesce(1), files, with_groups=False)
    many = align(docs.repartition(16), files, with_groups=False)
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0 and one.count() == docs.count()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab ,.\n▁éß漢🎉1<|s>"), max_size=40), min_size=1, max_size=4))
def test_any_texts(files, encoders, texts):
    found = token_alignment.align_texts(texts, files)
    links = list(zip(found.link_a.tolist(), found.link_b.tolist(), strict=True))
    for i, t in enumerate(texts):
        groups, own = plain(t, encoders)
        assert found.groups[i] == groups and found.n_links[i] == len(own)
        assert Counter(links[: len(own)]) == Counter(own)
        links = links[len(own) :]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 40), st.lists(st.tuples(st.integers(0, 39), st.integers(0, 39)), max_size=60))
def test_union_find(n, edges):
    edges = [(a % n, b % n) for a, b in edges]
    least = list(range(n))
    for _ in range(n):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    a, b = (np.array([e[i] for e in edges], np.int64) for i in (0, 1))
    assert union_find(a, b, n).tolist() == least
