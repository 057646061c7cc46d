"""Filters over whole recordings equal the kernel over the whole signal, whatever the blocks."""

import numpy as np
import pandas as pd
import pytest

from pulsegrid.functions import kernels
from pulsegrid.operators import recordings, signals


@pytest.mark.parametrize(("high", "hertz", "block"), [(False, 16.0, 300), (True, 0.5, 1000), (True, 0.5, 1 << 14)])
def test_block_scan_equals_the_whole_signal(spark, high, hertz, block):
    rng = np.random.default_rng(1)
    lengths = {1: 5000, 2: 16, 3: 15, 4: 1999}
    x = {s: 80_000 + np.cumsum(rng.normal(size=n)) * 20 for s, n in lengths.items()}
    frame = pd.concat([pd.DataFrame({"subject_id": s, "seq": np.arange(1, len(v) + 1), "ir": v}) for s, v in x.items()])
    sections = kernels.butterworth(4, hertz, 400.0, high)
    rows = recordings.zero_phase(spark.createDataFrame(frame.sample(frac=1, random_state=0)), sections, block=block).toPandas().sort_values(["subject_id", "seq"])
    for s, v in x.items():
        mine = rows[rows.subject_id == s]
        assert mine.seq.tolist() == list(range(1, len(v) + 1))
        if len(v) <= 15:
            assert mine.ir.isna().all()
        else:
            np.testing.assert_allclose(mine.ir.to_numpy(), kernels.zero_phase(sections, v[None])[0], rtol=1e-9, atol=1e-10 * np.abs(v).max())


@pytest.mark.parametrize("block", [7, 64, 1 << 13])
def test_decimation_in_blocks(spark, block):
    rng = np.random.default_rng(2)
    frame = pd.concat([pd.DataFrame({"subject_id": s, "seq": np.arange(1, n + 1), "ir": rng.normal(size=n), "red": rng.normal(size=n)}) for s, n in ((1, 200), (2, 5), (3, 1))])
    rows = signals.decimated(spark.createDataFrame(frame), 4, 21, block=block).toPandas().sort_values(["subject_id", "seq"])
    for s, own in frame.groupby("subject_id"):
        mine = rows[rows.subject_id == s]
        assert mine.seq.tolist() == list(range(1, len(mine) + 1))
        for c in ("ir", "red"):
            np.testing.assert_allclose(mine[c].to_numpy(), kernels.decimate(own[c].to_numpy(), 4, 21), atol=1e-12)


def test_blocks_of_many_recordings_go_together(spark, monkeypatch):
    """Blocks of one length are one stack; stacks, Arrow batches and the recordings in them may end anywhere. Readings are read once."""
    sections = kernels.butterworth(4, 16.0, 400.0)
    rng = np.random.default_rng(4)
    space, v = recordings.StateSpace.of(sections), rng.normal(size=(5, 300))
    out, end = space.run(v, np.zeros((5, 4)))
    assert out.shape == v.shape and end.shape == (5, 4)
    np.testing.assert_allclose(out[3:4], space.run(v[3:4], np.zeros((1, 4)))[0], atol=1e-12)

    monkeypatch.setattr(recordings, "HELD", 150)
    frame = pd.concat([pd.DataFrame({"subject_id": s, "seq": np.arange(1, n + 1), "ir": rng.normal(size=n)}) for s, n in enumerate(rng.integers(10, 400, 30))])
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for p in parts:
            seen.add(len(p))
            yield p

    read = spark.createDataFrame(frame).mapInPandas(count, "subject_id long, seq long, ir double")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = recordings.zero_phase(read, sections, block=48).toPandas().sort_values(["subject_id", "seq"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert seen.value == len(frame) == len(rows)
    for s, own in frame.groupby("subject_id"):
        mine, n = rows[rows.subject_id == s], len(own)
        assert mine.seq.tolist() == list(range(1, n + 1))
        if n > 15:
            np.testing.assert_allclose(mine.ir.to_numpy(), kernels.zero_phase(sections, own.ir.to_numpy()[None])[0], atol=1e-10)
        else:
            assert mine.ir.isna().all()
