"""Sketches against exact ranks: bounds, merges, deletions."""

import numpy as np
from pyspark.sql import functions as F

from flowquarry.llm import percentiles as P

NAN, INF = float("nan"), float("inf")


def off_by(values, estimate, p):
    """How many ranks the estimate is off, up to its relative error."""
    v = np.sort(values)
    lo, hi = sorted((estimate * (1 - P.RELATIVE_ERROR), estimate * (1 + P.RELATIVE_ERROR)))
    a, b = np.searchsorted(v, lo), np.searchsorted(v, hi, "right")
    k = max(1, int(np.ceil(p * len(v))))
    return 0 if a < k <= b else min(abs(a + 1 - k), abs(b - k))


def test_cells_follow_values():
    rng = np.random.default_rng(1)
    v = np.sort(np.concatenate([rng.lognormal(0, 20, 5000), -rng.lognormal(0, 20, 5000), [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308]]))
    c = P.cells_of(v)
    assert (np.diff(c) >= 0).all() and c.min() >= 0 and c.max() < 1 << P.BITS
    w = v[(np.abs(v) > 1e-300)]
    assert (np.abs(P.value_of(P.cells_of(w)) - w) <= P.RELATIVE_ERROR * 1.0001 * np.abs(w)).all()


def state(v):
    return P.State().add_cells(P.cells_of(np.asarray(v, float)), np.ones(len(v), np.int64))


def quantiles(s, probs):
    q, bound = P.quantiles(P.all_counters([s]), probs)
    return q[0].tolist(), bound[0]


def test_states_of_any_size_stay_within_their_bound():
    rng = np.random.default_rng(2)
    probs = [0.001, 0.05, 0.5, 0.9, 0.999]
    for v in (rng.lognormal(5, 3, 300_000), np.concatenate([np.full(100_000, 7.0), rng.normal(0, 1e6, 200_000)]), rng.lognormal(5, 0.3, 300_000), rng.lognormal(4, 2, 100), np.r_[np.zeros(1000), rng.lognormal(2, 2, 1000)], np.full(50_000, -3.25)):
        s = P.State()
        for part in np.array_split(v, 9):
            s.add(state(part).blob())
        q, bound = quantiles(s, probs)
        assert bound < 0.025 * len(v)
        for p, x in zip(probs, q):
            assert off_by(v, x, p) <= bound + 1
            assert off_by(v, x, p) <= 0.002 * len(v) + 1


def test_bound_fails_as_seldom_as_stated():
    rng = np.random.default_rng(8)
    bad = n = 0
    for _ in range(60):
        v = rng.lognormal(3, 0.02, 3000)  # few codes apart: hard
        q, bound = quantiles(state(v), [0.1, 0.3, 0.5, 0.7, 0.9])
        bad += sum(off_by(v, x, p) > bound + 1 for p, x in zip([0.1, 0.3, 0.5, 0.7, 0.9], q))
        n += 5
    assert bad <= P.DELTA * n


def test_form_and_order_make_no_difference():
    rng = np.random.default_rng(3)
    parts = [rng.lognormal(4, 2, n) for n in (10, 60_000, 300, 60_000)] + [rng.lognormal(0, 20, 200_000)]
    blobs = [state(v).blob() for v in parts]
    assert {b[0] for b in blobs} == {0, 1}
    one, two = P.State(), P.State()
    for b in blobs:
        one.add(b)
    for b in reversed(blobs):
        two.add(b)
    three = state(np.concatenate(parts))
    assert one.blob() == two.blob() == three.blob()
    assert (P.all_counters([one]) == P.all_counters([P.State().add(b) for b in blobs]).sum(0)).all()
    left = P.State().add(one.blob()).add(blobs[1], -1).add(blobs[3], -1).add(blobs[4], -1)
    apart = P.State().add(blobs[0]).add(blobs[2])
    assert left.counters is not None and apart.counters is None
    assert (P.all_counters([left]) == P.all_counters([apart])).all()
    assert quantiles(left, [0.5]) == quantiles(apart, [0.5])
    whole, folded = P.State(), P.State()
    for k, b in enumerate(blobs):  # weights of -1, folded together or apart
        whole.add(b, 1 if k % 2 else -1)
        folded.add(P.State().add(b, 1 if k % 2 else -1).blob())
    assert (P.all_counters([whole]) == P.all_counters([folded])).all()


def test_groups_unions_and_odd_values(spark):
    rng = np.random.default_rng(4)
    data = [(str(rng.choice(["a", "b", "hot", "hot"])), int(rng.integers(0, 3)), float(v)) for v in rng.lognormal(2, 2, 4000)] + [("a", 0, None), ("a", 0, NAN), ("b", 1, INF), ("b", 1, -INF), (None, 1, 5.0), ("none", 1, None), ("a", None, 3.0)]
    df = spark.createDataFrame(data, "source string, d int, `x/s` double").withColumn("measure", F.lit("clash")).withColumn("state", F.lit(1))
    states = P.sketch_states(df, {"source": F.col("source"), "day": F.col("d")}, ["x/s"]).cache()
    merged = P.merge_states(states, {"source": F.col("source")})
    for got, keys in ((P.percentiles(states, [0.5, 0.99]), ("source", "day")), (P.percentiles(merged, [0.5, 0.99]), ("source",)), (P.percentiles(P.merge_states(states, {"all": F.lit(None).cast("string")}), [0.5, 0.99]), ())):
        seen = 0
        for r in got.collect():
            v = [x for s, d, x in data if all(r[k] == {"source": s, "day": d}[k] for k in keys)]
            fin = [x for x in v if x is not None and np.isfinite(x)]
            assert (r["n"], r["missing"], r["non_finite"]) == (len(fin), sum(x is None or np.isnan(x) for x in v), sum(x is not None and np.isinf(x) for x in v))
            seen += len(v)
            if fin:
                for p, c in ((0.5, "p50"), (0.99, "p99")):
                    assert off_by(np.array(fin), r[c], p) <= r["rank_error"] + 1
            else:
                assert r["p50"] is None
        assert seen == len(data)
    gone = P.sketch_states(df.where("source = 'hot'"), {"source": F.col("source"), "day": F.col("d")}, ["x/s"])
    rest = P.percentiles(P.merge_states(P.subtract_states(states, gone, ["source", "day"]), {"source": F.col("source")}), [0.5])
    assert {r["source"]: r["n"] for r in rest.collect()}["hot"] == 0
    resent = P.merge_states(P.sketch_states(df.unionByName(df.where("source = 'a'")), {"source": F.col("source")}, ["x/s"]), {"source": F.col("source")})
    less = P.subtract_states(resent, P.sketch_states(df.where("source = 'a'"), {"source": F.col("source")}, ["x/s"]), ["source"])
    assert sorted(map(str, P.percentiles(less, [0.1, 0.5]).collect())) == sorted(map(str, P.percentiles(P.sketch_states(df, {"source": F.col("source")}, ["x/s"]), [0.1, 0.5]).collect()))
    again = P.sketch_states(df.repartition(7), {"source": F.col("source"), "day": F.col("d")}, ["x/s"])
    assert sorted(map(str, again.collect())) == sorted(map(str, states.collect()))
    assert P.sketch_states(df.limit(0), {"source": F.col("source")}, ["x/s"]).collect() == []
