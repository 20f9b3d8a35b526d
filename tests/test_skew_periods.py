"""Problems 5 and 6 against brute force, with nulls, ties, copies, empty tables and clashing names."""

import random
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from traceloom.operators import periods, skew


def observations(n=3000, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append({
            "device_id": r.choice(["a", "a", "a", "b", None]), "id": i, "app_id": r.choice([1] * 6 + [2, 3, 4, None, 5]),
            "ts": r.choice([None] * 1 + [r.randrange(0, 90_000_000) for _ in range(20)] + [600_000, 900_000]),
        })
    return rows + rows[::7]  # delivered twice


def test_per_key_result_equals_counting(spark, store):
    rows = observations()
    d = store(observations=rows, apps=[{"id": 1, "bundle_id": "Com.A"}, {"id": 1, "bundle_id": "Com.A"}, {"id": None, "bundle_id": "none"}])
    got = {r["app_id"]: (r["observations"], r["first_ts"], r["last_ts"]) for r in skew.app_activity(spark, d).collect()}
    count = Counter(r["app_id"] for r in rows)
    times = {k: [r["ts"] for r in rows if r["app_id"] == k and r["ts"] is not None] for k in count}
    assert got == {k: (n, min(times[k]), max(times[k])) for k, n in count.items()}
    assert {r["app_id"] for r in skew.heavy_apps(spark, d).collect()} == {k for k, n in count.items() if k is not None and n * 20 >= len(rows)}


def test_a_heavy_key_is_split_and_tasks_are_even(spark, store):
    d = store(observations=observations(8000))
    rows = spark.read.parquet(f"{d}/observations.parquet").select("app_id", "device_id", "id")
    how = skew.plan(rows, "app_id", 6)
    from pyspark.sql import functions as F

    sizes = [r["count"] for r in skew.placed(rows, "app_id", F.xxhash64("id"), how).groupBy("task").count().collect()]
    assert len({t for k, *_, t in how.heavy if k == 1}) > 1
    assert max(sizes) < 1.6 * sum(sizes) / 6


def test_packing_takes_the_largest_first():
    loads = Counter()
    for (_, n), (_, t) in zip(sorted([("a", 9), ("b", 5), ("c", 4), ("d", 1)], key=lambda x: -x[1]), skew.packing([("a", 9), ("b", 5), ("c", 4), ("d", 1)], 2)):
        loads[t] += n
    assert sorted(loads.values()) == [9, 10] and skew.packing([], 3) == []


def test_empty_tables_give_no_rows(spark, store):
    d = store()
    assert skew.app_activity(spark, d).count() == 0 and skew.heavy_apps(spark, d).count() == 0
    assert periods.device_periods(spark, d).count() == 0 and periods.period_apps(spark, d).count() == 0


def brute(rows, gap):
    out, seen = [], set()
    live = sorted({(r["device_id"] or "", r["ts"], r["id"]) for r in rows if r["ts"] is not None})
    for dev, ts, _ in live:
        if out and out[-1][0] == dev and ts - out[-1][2] < gap:
            out[-1][2], out[-1][3] = ts, out[-1][3] + 1
        else:
            out.append([dev, ts, ts, 1])
    return {tuple(x) for x in out}


def test_periods_equal_the_loop(spark, store):
    rows = observations(4000, 5)
    rows += [{"device_id": "c", "id": i, "ts": t, "app_id": 1} for i, t in enumerate([0, 299_999, 599_999, 899_998, 21_599_999, 21_600_000, 21_900_000])]
    rows += [{"device_id": "a", "id": 9_000_000, "ts": 5, "deleted_at": 1}, {"device_id": "a", "id": 9_000_001, "ts": 6, "origin_device": "x"}]
    d = store(observations=rows)
    live = [r for r in rows if "deleted_at" not in r and "origin_device" not in r]
    got = {(r["device_id"] or "", r["start_ts"], r["end_ts"], r["observations"]) for r in periods.device_periods(spark, d).collect()}
    assert got == brute(live, 300_000)
    apps = periods.period_apps(spark, d).groupBy("device_id", "start_ts").sum("observations").collect()
    assert {(r[0] or "", r[1], r[2]) for r in apps} == {(a, b, n) for a, b, _, n in got}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=40), st.integers(1, 70))
def test_closing_joins_bits_less_than_a_gap_apart(times, gap):
    ts = np.array(sorted(times))
    _, lo, hi = periods.closed(np.zeros(len(ts), int), ts, gap)
    want = []
    for t in sorted(set(times)):
        if want and t - want[-1][1] < gap:
            want[-1][1] = t
        else:
            want.append([t, t])
    assert [list(x) for x in zip(lo, hi)] == want
