"""Sliding windows by block aggregates, against every window's own points."""

import math
from collections import defaultdict

import numpy as np
import pytest

from ebbtide.model import SeriesFrame
from ebbtide.operators import monitors as mon
from ebbtide.operators import sliding

STEP = 1000


def brute(rows, ticks, reach, of):
    out = {}
    for tick, to in ticks:
        held = defaultdict(list)
        for key, t, v in rows:
            if v is not None and to - reach <= t < to:
                held[key].append((t, v))
        out |= {(tick, key): of(sorted(x)) for key, x in held.items()}
    return out


OF = {
    "avg": lambda x: sum(v for _, v in x) / len(x), "sum": lambda x: sum(v for _, v in x), "min": lambda x: min(v for _, v in x), "max": lambda x: max(v for _, v in x), "last": lambda x: x[-1][1],
    "l2norm": lambda x: math.sqrt(sum(v * v for _, v in x)), "area": lambda x: x[0][1] if len(x) == 1 else sum(v for _, v in x) * STEP / 1000,
}


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(11)
    rows = [(key, int(t) * STEP, float(rng.normal(0, 5)) if rng.random() > 0.1 else None) for key in ("a", "b", None) for t in rng.choice(np.arange(-20, 80), 35, replace=False)]
    return rows, SeriesFrame(spark.createDataFrame(rows, "k string, bucket_ms long, value double"), ("k",), STEP, 0, 80_000)


def ticks_of(spark, reach, every=700):
    ticks = [(t, t // STEP * STEP) for t in range(-25_000, 90_000, every)]
    return ticks, spark.createDataFrame([(t, to - reach, to) for t, to in ticks], "tick long, from_ms long, to_ms long")


@pytest.mark.parametrize("reach", [1000, 3000, 7000, 60_000, 500_000])
def test_windows_equal_their_points(spark, series, reach):
    rows, sf = series
    ticks, periods = ticks_of(spark, reach, 700 if reach < 60_000 else 5100)
    for how in ("avg", "last", "area") if reach > 3000 else OF:
        got = {(r.tick, r.k): r.value for r in mon.mon_threshold(sf, periods, how).collect()}
        want = brute(rows, ticks, reach, OF[how])
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_full_windows_of_slots_wider_than_the_step(spark, series):
    rows, sf = series
    ticks, periods = ticks_of(spark, 12_000)

    def full(to):
        def of(x):
            slots = {(t - (to - 12_000)) // 3000 for t, _ in x}
            return min(slots) == 0 and 4 - len(slots) <= 3

        return of

    got = {(r.tick, r.k): r.full for r in mon.mon_full_window(sf.with_df(sf.df.where("value is not null")), periods, 3000).collect()}
    want = {k: v for tick, to in ticks for k, v in brute(rows, [(tick, to)], 12_000, full(to)).items()}
    assert got == want and len(set(got.values())) == 2


def test_no_ticks_and_unlike_windows(spark, series):
    none = spark.createDataFrame([], "tick long, from_ms long, to_ms long")
    assert mon.mon_threshold(series[1], none).collect() == [] and mon.mon_full_window(series[1], none, 3000).collect() == []
    with pytest.raises(ValueError, match="one length"):
        mon.mon_threshold(series[1], spark.createDataFrame([(1, 0, 5), (2, 0, 6)], "tick long, from_ms long, to_ms long"))


def test_rows_do_not_grow_with_the_window(spark, series):
    """A window makes two rows for each group that it meets, of however many buckets it consists."""
    _, sf = series
    ends = spark.createDataFrame([(t,) for t in range(0, 80_000, 1000)], "to_ms long")
    for reach in (10_000, 1_000_000):
        made = sliding.sliding(sf.df, sf.keys, ends, reach)
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "explode" not in plan
        assert made.count() <= 80 * 3
