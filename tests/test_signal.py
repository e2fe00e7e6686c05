import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import signal as S


def slow_pitch(x, rate):
    """Frame by frame, lag by lag."""
    frame, hop = max(256, int(rate * 0.05)), max(128, int(rate * 0.05))
    out = []
    for at in range(0, max(0, len(x) - frame + 1), hop):
        s = np.asarray(x[at : at + frame], float)
        if 10 * np.log10((s * s).mean() + 1e-12) < -38:
            out.append(None)
            continue
        s = (s - s.mean()) * np.hanning(frame)
        least, most = max(1, int(rate / 350)), max(max(1, int(rate / 350)) + 1, int(rate / 70))
        ac = [float((s[: frame - k] * s[k:]).sum()) for k in range(frame)]
        most = min(most, frame - 1)
        lag = max(range(least, most + 1), key=lambda k: (ac[k], -k))
        ok = ac[0] > 1e-12 and ac[lag] / ac[0] >= 0.25 and 70 <= rate / lag <= 350
        out.append(rate / lag if ok else None)
    return out


@pytest.mark.parametrize("hz", [80, 110, 147.5, 220, 300, 340])
def test_sines(hz):
    rate = 24_000
    x = 0.3 * np.sin(2 * np.pi * hz * np.arange(rate) / rate)
    found = S.frame_pitch(x, rate)
    assert len(found) == 20 and np.all(np.abs(found - hz) < 0.025 * hz + hz * hz / rate)  # the window favours short lags a little


def test_out_of_range_silent_and_short():
    rate = 24_000
    t = np.arange(rate) / rate
    assert np.isnan(S.frame_pitch(0.001 * np.sin(2 * np.pi * 100 * t), rate)).all()  # below -38 dB
    assert np.isnan(S.frame_pitch(np.zeros(rate), rate)).all() and len(S.frame_pitch(np.zeros(100), rate)) == 0
    assert np.isnan(S.frame_pitch(np.random.default_rng(1).normal(0, 0.2, rate), rate)).all()  # noise has no pitch


def test_against_lag_by_lag():
    g = np.random.default_rng(2)
    for rate in (2000, 8000, 16_000):
        x = 0.3 * np.sin(2 * np.pi * np.cumsum(g.uniform(80, 300, 40).repeat(rate // 20)) / rate) + g.normal(0, 0.1, rate * 2)
        got = [None if np.isnan(v) else float(v) for v in S.frame_pitch(x, rate)]
        assert got == slow_pitch(x, rate)


def test_many_frames_in_steps(monkeypatch):
    x = 0.3 * np.sin(2 * np.pi * 120 * np.arange(50_000) / 8000)
    whole = S.frame_pitch(x, 8000)
    monkeypatch.setattr(S, "_TOGETHER", 7)
    assert np.array_equal(S.frame_pitch(x, 8000), whole, equal_nan=True)


def test_columns(spark):
    rate = 8000
    t = np.arange(rate * 2) / rate
    glide = (0.4 * np.sin(2 * np.pi * (100 * t + 20 * t * t))).tolist()
    d = spark.createDataFrame([(0, glide), (1, [0.0] * 4000), (2, None), (3, []), (4, glide[:2000])], "i int, s array<double>")
    rows = d.withColumn("f0", S.pitch(rate)(F.col("s"))).withColumn("spread", S.semitone_spread(F.col("f0"))).orderBy("i").collect()
    f0 = np.array([v for v in rows[0].f0 if v is not None])
    assert rows[0].spread == pytest.approx(float(np.std(12 * np.log2(f0 / np.median(f0)))), abs=1e-9) and len(rows[0].f0) == len(slow_pitch(glide, rate))
    assert rows[1].spread is None and set(rows[1].f0) == {None} and rows[2].f0 is None and rows[2].spread is None and rows[3].f0 == []
    assert len(rows[4].f0) == 5
