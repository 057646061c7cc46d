"""Packing, token counts, languages, audio and the quality classifier."""

import hashlib
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import language_mix, mpeg_audio, packing, queries, quality_mil, token_counts


def test_pack_holds_every_id_once(documents, edge, empty):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(queries.byte_bpe()[0])
    for docs in (documents, edge):
        rows = packing.pack(docs, queries.byte_bpe()).collect()
        want = sorted((r.doc_id or -1, tuple([*exact.encode(r.text or "", add_special_tokens=False).ids, 0])) for r in docs.collect())
        by, places = defaultdict(list), defaultdict(list)
        for r in rows:
            assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
            places[r.sequence_id].append((r.offset, r.length))
            by[r.doc_id or -1].append(r)
        total = sum(len(ids) for _, ids in want)
        assert sum(r.length for r in rows) == total and sorted(places) == list(range(-(-total // 1024)))
        for seq in places.values():
            end = 0
            for offset, length in sorted(seq):
                assert offset == end
                end += length
            assert end <= 1024
        if docs is documents:
            for k, ids in want:
                got = sorted(by[k], key=lambda r: r.start)
                assert [i for r in got for i in r.ids] == list(ids) and {r.doc_tokens for r in got} == {len(ids)}
    assert packing.pack(empty, queries.byte_bpe()).count() == 0


def spread(s, totals, step=137):
    """Tokens of each source in each round, from the places of documents of ``step`` tokens; every place is taken once."""
    cut = [(i, p, min(step, t - p)) for i, t in enumerate(totals) for p in range(0, t, step)]
    src, start, n = (np.array(c, np.int64) for c in zip(*cut))
    doc, at, length, seq, offset = s.places(src, start, n)
    seen, per = np.zeros(sum(totals), int), np.zeros((s.rounds, len(totals)), int)
    for a, m in zip(seq * s.window + offset, length):
        seen[a : a + m] += 1
    assert (seen == 1).all() and (offset + length <= s.window).all() and s.rounds == -(-sum(totals) // s.window)
    np.add.at(per, (seq, src[doc]), length)
    got = np.zeros(sum(totals), int)  # every token of every document lies in one piece
    base = np.cumsum([0, *totals])
    for d, a, m in zip(doc, at, length):
        got[base[src[d]] + start[d] + a : base[src[d]] + start[d] + a + m] += 1
    assert (got == 1).all()
    return per


@pytest.mark.parametrize("totals", [[50_000, 20_000, 700, 0, 9_000], [300] * 40 + [90_000, 4], [7], [3000] * 200, [100_000, 1, 2, 3]])
def test_windows_follow_the_proportions(totals):
    s = packing.Schedule(totals, [float(t) for t in totals], 1024, 16)
    per = spread(s, totals)
    want = 1024 * np.array(totals) / sum(totals)
    large = np.setdiff1d(np.arange(len(totals)), s.small)
    assert (np.abs(per[:-3] - want)[:, large] < 2).all()  # the rounding of two windows' ends
    assert (np.abs(per[:-3] - want) < 16 + 2).all()
    drift = np.abs(np.cumsum(per, 0)[:-3] - want * np.arange(1, s.rounds + 1)[:-3, None])
    assert (drift[:, large] < 1.01).all() and (drift < 2 * 16).all()
    assert (want < 16).any() or not len(s.small)


def test_weights_hold_until_a_queue_is_empty():
    totals, weights = [50_000, 20_000, 700, 9_000], [1.0, 3.0, 1.0, 2.0]
    per = spread(packing.Schedule(totals, weights, 1024, 16), totals)
    assert (np.abs(per[:3] - 1024 * np.array(weights) / 7) < 2).all() and (per[:, 2] > 0).sum() <= 6
    gone = np.flatnonzero(np.cumsum(per[:, 2]) == 700)[0]
    assert (np.abs(per[gone + 2 : gone + 6] - 1024 * np.array([1, 3, 0, 2]) / 6) < 2).all()


def test_windows_of_the_real_sources(spark, sf_dir):
    """All 20 sources in every full window, none a grain away from its share; the deficit is what is still to come."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs, queries.byte_bpe(), with_ids=False).collect()
    per, last, total = defaultdict(lambda: defaultdict(int)), {}, defaultdict(int)
    for r in rows:
        per[r.sequence_id][r.source] += r.length
        total[r.source] += r.length
    everything = sum(total.values())
    assert len(total) == docs.select("source").distinct().count()
    for k in range(max(per) - 2):
        assert sum(per[k].values()) == 1024
        assert all(abs(per[k][x] - 1024 * total[x] / everything) <= packing.GRAIN for x in total)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        last[r.source, r.sequence_id] = r.deficit
    assert all(abs(d) <= packing.GRAIN + 1 for (_, k), d in last.items() if k < max(per) - 2)


def test_token_counts_equal_the_library(edge, empty):
    import sentencepiece

    path = queries.vocabulary("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    random.seed(3)
    alphabet = "abcdefgh  ▁▁\n\tàéß漢字🎉<s></s><unk>\x00.,!"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) for _ in range(3000)]
    texts += ["", " ", "  ", "▁", "a ", " a", "<s>", "\x00", "x" * 500, " " * 300, "the " * 200]
    assert token_counts.count_tokens(texts, path) == [len(x) for x in lib.encode(texts)]
    rows = token_counts.token_counts(edge, path).collect()
    text = [r.text or "" for r in edge.collect()]
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == sorted((len(t.encode()), len(lib.encode(t))) for t in text)
    assert all(r.over_limit == (r.n_tokens > 4096) for r in rows)
    assert token_counts.token_counts(empty, path).count() == 0


def test_long_texts_without_spaces_take_linear_time():
    import sentencepiece

    path = queries.vocabulary("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    kinds = ["x", "ab", "ing", "abcdefghijklmnopqrstuvwxyz", "ABCDEFabcdef0123456789+/", "漢字和日本語テスト", "ไทยภาษา", "=-", "\u2581a"]
    texts = ["".join(rng.choice(k) for _ in range(n)) for k in kinds for n in (255, 256, 257, 258, 5000)]
    assert token_counts.count_tokens(texts, path) == [len(x) for x in lib.encode(texts)]
    for kind in ("abcdefghijklmnopqrstuvwxyz", "x", "漢字和日本語"):
        text = "".join(rng.choice(kind) for _ in range(1_000_000))
        began = time.process_time()
        assert token_counts.count_tokens([text], path) == [len(lib.encode(text))]
        assert time.process_time() - began < 60


def test_languages(spark, sf_dir, edge, empty, documents):
    rows = queries.op7_language_mix(spark, sf_dir).collect()
    truth = {r.doc_id: r.lang for r in documents.collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    names, table = language_mix.learn(documents)
    en, fr = (next(r.text for r in documents.where(f"lang = '{x}' AND length(text) > 1500").limit(1).collect())[:1500] for x in ("en", "fr"))
    both = language_mix.infer([en + " " + fr], table)[0]
    assert {n for n, p in zip(names, both) if p > 0.2} == {"en", "fr"}
    got = language_mix.identify(edge, names, table).collect()
    assert len(got) == edge.count() and sum(r.lang_pred == "und" for r in got) == 4
    assert language_mix.learn(empty)[0] == [] and language_mix.identify(empty, names, table).count() == 0
    assert {r.lang_pred for r in language_mix.identify(edge, *language_mix.learn(empty)).collect()} == {"und"}

def test_isolated_letters_have_a_language(spark, documents):
    names, table = language_mix.learn(documents)
    lone = spark.createDataFrame([(1, "A."), (2, "a"), (3, "I I 7 x!"), (4, "É"), (5, "7 !"), (6, "— 🎉"), (7, None), (8, "½ ²"), (9, "\u0301\u0300"), (10, "x1y2"), (11, "I a")], "doc_id long, text string")
    got = {r.doc_id: r for r in language_mix.identify(lone, names, table).collect()}
    assert all(got[k].lang_pred in names and got[k].score > 0 and got[k].proportions for k in (1, 2, 3, 4, 10, 11))
    assert all((got[k].lang_pred, got[k].score) == ("und", 0) for k in (5, 6, 7, 8, 9))
    taught = lone.where("doc_id < 4").withColumn("lang", F.lit("en"))
    assert language_mix.learn(taught)[0] == ["en"]


def test_long_texts_are_counted_in_slabs(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abé 漢.7 ") for _ in range(n)) for n in (0, 1, 5, 31, 32, 33, 700)]
    whole = language_mix.trigrams(texts)
    monkeypatch.setattr(language_mix, "CHUNK", 16)
    monkeypatch.setattr(quality_mil, "SLAB", 16)
    for i, text in enumerate(texts):
        _, bucket, n = language_mix.trigrams([text])
        mine = whole[0] == i
        assert bucket.tolist() == whole[1][mine].tolist() and n.tolist() == whole[2][mine].tolist()
    slabs = [quality_mil.passages([x])[0] for x in texts]
    monkeypatch.setattr(quality_mil, "SLAB", 1 << 21)
    assert np.allclose(np.vstack(slabs), quality_mil.passages(texts)[0], atol=1e-6)


@pytest.mark.parametrize("text", [None, "", "a", "x" * 191, "x" * 192, "x" * 193, "é" * 5000])
def test_audio_round_trip(text):
    payload = mpeg_audio.pad(text)
    stored = mpeg_audio.encode(payload)
    s = mpeg_audio.parse(stored)
    assert mpeg_audio.payload_of(s) == payload and len(payload) % 192 == 0
    assert (s.bad_checksums, s.skipped, s.hertz, s.samples) == (0, 0, 48000, 1152 * len(s.frames))
    assert s.table["frames"] == len(s.frames) and s.tags == {"TIT2": "payload"}
    assert all(mpeg_audio.read_header(stored[p : p + 4]) for p in s.frames)


def test_audio_resynchronises():
    stored = mpeg_audio.encode(mpeg_audio.pad("y" * 5000))
    whole = mpeg_audio.parse(stored)
    at = whole.frames[2]
    junk = stored[:at] + b"\xff\xfb junk \xff" + stored[at:]
    s = mpeg_audio.parse(junk)
    assert len(s.frames) == len(whole.frames) and s.skipped == 9 and s.frames[2] == at + 9
    broken = bytearray(stored)
    broken[at + 4] ^= 1  # the checksum of one frame
    assert mpeg_audio.parse(bytes(broken)).bad_checksums == 1
    assert len(mpeg_audio.parse(stored + b"TAG" + b"Title".ljust(125, b"\0")).frames) == len(whole.frames)
    assert mpeg_audio.parse(b"no audio at all \xff\xff").frames == []


def test_audio_other_kinds():
    # MPEG 1 layer II, 192 kbit/s, 44.1 kHz, unprotected: 626 bytes; MPEG 2 layer III, 64 kbit/s, 22.05 kHz: 208
    two = bytes((0xFF, 0xFD, 10 << 4, 0x00)).ljust(626, b"\1")
    three = bytes((0xFF, 0xF3, 8 << 4, 0xC0)).ljust(208, b"\1")
    s = mpeg_audio.parse(two * 3)
    assert (len(s.frames), s.samples, s.hertz, s.milliseconds) == (3, 3456, 44100, 78)
    s = mpeg_audio.parse(three * 2)
    assert (len(s.frames), s.samples, s.hertz) == (2, 1152, 22050)
    assert mpeg_audio.crc16(b"123456789") == 0xAEE7  # CRC-16/CMS


def frame_of(header, size, bits):
    """A frame with a right checksum over header and ``bits`` bits behind it; all bits of the body set."""
    body = b"\xff" * (size - 6)
    return header + mpeg_audio.crc16(header[2:] + body, bits=16 + bits).to_bytes(2, "big") + body


def test_audio_checksums_of_layers_one_and_two():
    # layer II, 192 kbit/s, 44.1 kHz, stereo: 30 subbands of 2 channels, 94 bits of allocation each, 60 selections of 2 bits
    two = bytes((0xFF, 0xFC, 10 << 4, 0x00))
    h = mpeg_audio.read_header(two)
    assert mpeg_audio.covered_bits(b"\xff" * 60, h) == 2 * 94 + 120 and mpeg_audio.covered_bits(bytes(60), h) == 2 * 94
    # joint stereo from subband 8 on: what is shared is stored once, but selected for both channels
    joint = mpeg_audio.read_header(bytes((0xFF, 0xFC, 10 << 4, 0x50)))
    assert joint.bound == 8 and mpeg_audio.covered_bits(b"\xff" * 60, joint) == 2 * 32 + (94 - 32) + 120
    good = frame_of(two, 626, 2 * 94 + 120)
    one = frame_of(bytes((0xFF, 0xFE, 12 << 4, 0x00)), mpeg_audio.read_header(bytes((0xFF, 0xFE, 12 << 4, 0x00))).size, 256)
    for frame in (good, one):
        bad = bytearray(frame)
        bad[7] ^= 0x80
        assert mpeg_audio.parse(frame * 3).bad_checksums == 0 and mpeg_audio.parse(frame + bytes(bad) + frame).bad_checksums == 1
        assert len(mpeg_audio.parse(frame + bytes(bad) + frame).frames) == 3


def test_audio_resynchronises_in_linear_time():
    began = time.process_time()
    for junk in (b"\xff\x00", b"\xff\xfb", b"ID3", b"TAG\xff"):
        s = mpeg_audio.parse(junk * (1_000_000 // len(junk)))
        assert not s.frames
    assert time.process_time() - began < 30


def test_media(edge, empty):
    rows = mpeg_audio.media(edge).collect()
    text = {r.doc_id: r.text for r in edge.collect() if r.doc_id}
    for r in rows:
        assert hashlib.sha256(r.media).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes
        assert r.seek_offsets == mpeg_audio.parse(r.media).frames and all(r.media[p] == 0xFF for p in r.seek_offsets)
        if r.doc_id:
            p = mpeg_audio.pad(text[r.doc_id])
            assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-16:])
    assert mpeg_audio.media(empty).count() == 0


def test_quality(spark, sf_dir, documents, edge, empty):
    rows = {r.doc_id: r for r in queries.op10_quality_mil(spark, sf_dir).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    test = [(rows[k].predicted, q) for k, q in labels.items() if rows[k].held_out]
    assert len(rows) == documents.count() and np.mean([p == q for p, q in test]) >= 0.8
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows.values())
    model = quality_mil.train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert quality_mil.score(edge, model).count() == edge.count() and quality_mil.score(empty, model).count() == 0
    kept = quality_mil.keep(edge, model)
    assert kept.columns == edge.columns and kept.count() == quality_mil.score(edge, model).where("predicted = 1").count()
    none = quality_mil.train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0))
    assert none.mean == 0.5


def test_long_texts_leave_the_sample_whole(spark, monkeypatch):
    """Ten labelled texts of 640 passages and more beside forty short ones, with a bound of 200 passages."""
    rows = [(i, " \n\x0b".join(f"{'#$' * (i % 2)}w{k}" for k in range(64 * (640 + i) if i < 10 else 70)) if i else " \t ", i % 2) for i in range(50)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, quality int").select("doc_id", "text"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    given, fit = [], quality_mil.fit
    monkeypatch.setattr(quality_mil, "fit", lambda x, n, y: given.append((x, n, y)) or fit(x, n, y, epochs=2))
    assert quality_mil.train(docs, labels, most_passages=200).mean is None
    x, n, y = given[0]
    # 1 for the text without words, 2 for each short one, 13 for each of nine long ones
    assert sorted(n.tolist()) == [1] + [2] * 40 + [13] * 9 and len(x) == 198 and y.sum() == 25
    whole, each = quality_mil.passages([rows[1][1]])
    assert each[0] == 641 and (quality_mil.pooled(whole, 641) is whole)
    some = quality_mil.pooled(whole, 13)
    assert np.allclose((some[:, :-5] ** 2).sum(1), 1, atol=1e-3) and np.allclose(some[:, -1], whole[:, -1].mean())


def test_attention_gradients():
    rng = np.random.default_rng(0)
    count = np.array([3, 1, 4])
    x = rng.standard_normal((8, quality_mil.WIDTH)).astype(np.float32)
    y = np.array([0, 1, 1], np.float32)
    model = quality_mil.fit(x, count, y, epochs=60, batch=3)
    out = model.forward(x, count)
    assert np.allclose(np.add.reduceat(out["a"], [0, 3, 4]), 1) and (out["p"][1:] > 0.9).all() and out["p"][0] < 0.1
    # the derivatives equal finite differences of the log loss, in double precision and away from the optimum
    model = quality_mil.Model({k: v.astype(float) for k, v in quality_mil.fit(x, count, y, epochs=1, batch=3).weights.items()})
    loss = lambda: -np.mean(np.where(y > 0.5, np.log(p := model.forward(x.astype(float), count)["p"]), np.log(1 - p)))
    for k, grad in quality_mil.gradients(model, x.astype(float), count, y).items():
        w = model.weights[k]
        for at in [tuple(rng.integers(0, n) for n in w.shape) for _ in range(6)]:
            old = w[at]
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-4 + 1e-3 * abs(grad[at]), (k, at)


def test_quality_with_more_rows_than_passages(spark):
    rows = [(i % 3, f"{'good text here' if i % 2 else '### $$$ %%%'} {i}") for i in range(60)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    one, two = (quality_mil.train(docs.repartition(n), labels, most_passages=20) for n in (1, 3))
    assert one.mean is None and all(np.array_equal(one.weights[k], two.weights[k]) for k in one.weights)
