"""Calibrated samples, packing and mixing."""

import re

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowquarry.llm import calibrate, mixing, packing
from flowquarry.llm.tokens import token_count


def records(spark, counts, group="g"):
    data, n = [], 0
    for c, k in counts.items():
        for _ in range(k):
            data.append((n, group, c))
            n += 1
    return spark.createDataFrame(data, "id long, group_key string, category string")


def plans(spark, data):
    return spark.createDataFrame(data, "plan_no long, group_key string, category string, target_share double, sample_rows long, min_rows long")


def test_sizes_shares_floors_and_gaps(spark):
    rec = records(spark, {"A": 1000, "B": 200, "C": 30, "D": 3, None: 5})
    pl = plans(spark, [(1, "g", "A", 0.5, 100, 5), (1, "g", "B", 0.4, 100, 5), (1, "g", "C", 0.06, 100, 5), (1, "g", "D", 0.04, 100, 5), (2, "g", "A", 0.333, 10, 0), (2, "g", "B", 0.667, 10, 0), (3, "none", "A", 1.0, 5, 1), (4, "g", "C", 0.9, 20, 0), (4, "g", "Z", 0.1, 20, 0), (5, "g", "C", None, None, None)])
    cal = calibrate.calibrated_plans(rec, pl).cache()
    t = {(r["plan_no"], r["category"]): r["target"] for r in cal.collect()}
    assert t[(1, "D")] == 3 and abs(sum(t[(1, c)] for c in "ABCD") - 100) < 1e-9 and t[(1, "C")] >= 5
    assert abs(t[(1, "A")] / t[(1, "B")] - 0.5 / 0.4) < 1e-9
    for seed in (1, 2):
        drawn = calibrate.pivotal_sample(rec, cal, seed=seed, chunk=50).cache()
        assert drawn.count() == drawn.dropDuplicates(["plan_no", "id"]).count()
        n = {(r["plan_no"], r["category"]): r["count"] for r in drawn.groupBy("plan_no", "category").count().collect()}
        assert sum(n[(1, c)] for c in "ABCD") == 100 and n[(1, "D")] == 3 and n[(1, "C")] >= 5
        assert all(abs(n[k] - v) < 1 for k, v in t.items() if v > 0)
        assert n[(2, "A")] + n[(2, "B")] == 10 and (3, "A") not in n
        assert rows(drawn) == rows(calibrate.pivotal_sample(rec.repartition(5), cal, seed=seed, chunk=50))
    report = calibrate.sample_report(cal, drawn).cache()
    assert {(r["plan_no"], r["category"]) for r in report.where("short").collect()} == {(1, "D"), (3, "A"), (4, "Z")}
    rep = report.where("plan_no = 1 and category = 'A'").first()
    assert abs(rep["share_reached"] - 0.5) < 0.02 and report.where("plan_no = 1 and category = 'D'").first()["gap"] == 2
    assert calibrate.calibrated_plans(rec, pl.limit(0)).collect() == [] and calibrate.pivotal_sample(rec.limit(0), cal).collect() == []


def test_probabilities_are_met(spark):
    rec = records(spark, {"A": 40})
    cal = calibrate.calibrated_plans(rec, plans(spark, [(p, "g", "A", 1.0, 10, 0) for p in range(300)]))
    hits = calibrate.pivotal_sample(rec, cal, chunk=7).groupBy("id").count().toPandas()["count"]
    assert len(hits) == 40 and abs(hits.mean() - 75) < 1e-9 and hits.std() < 16


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 50), st.integers(0, 10)), min_size=1, max_size=6), st.integers(0, 80))
def test_targets(parts, size):
    share = np.array([p[0] for p in parts])
    share = share / share.sum() if share.sum() > 0 else share
    have, floor = np.array([p[1] for p in parts], float), np.array([p[2] for p in parts], float)
    lam, t, _ = calibrate.calibrate(have, share, size, floor)
    assert (t <= have + 1e-9).all() and (t >= np.minimum(floor, have) - 1e-9).all()
    ok = (have > 0) & (t > 0) & (size > 0)
    assert np.allclose((have * max(size, 1) / max(have.sum(), 1) * np.exp(lam))[ok], t[ok], rtol=1e-9)
    least, most = np.minimum(floor, have).sum(), np.where(share > 0, have, np.minimum(floor, have)).sum()
    assert abs(t.sum() - max(least, min(size, most))) < 1e-6
    free = (t > np.minimum(floor, have) + 1e-9) & (t < have - 1e-9)
    if free.sum() > 1:  # neither at a floor nor at the end: shares are as wanted
        assert np.allclose(t[free] / t[free].sum(), share[free] / share[free].sum(), rtol=1e-6)


def test_fights():
    rng = np.random.default_rng(4)
    n = 4000
    group = np.sort(rng.integers(0, 300, n))
    p = rng.choice([0.0, 1.0, 0.1, 0.5, 0.93], n)
    total = np.zeros(n)
    for k in range(200):
        got = calibrate.fights(p.copy(), group, rng.integers(-(2**62), 2**62, n))
        open_ = (got > 0) & (got < 1)
        assert np.bincount(group[open_], minlength=300).max() <= 1
        assert np.allclose(np.bincount(group, weights=got), np.bincount(group, weights=p))
        total += got
    assert np.abs(total / 200 - p).max() < 0.15 and abs((total / 200 - p).mean()) < 1e-3
    assert calibrate.fights(np.zeros(0), np.zeros(0, int), np.zeros(0, np.int64)).tolist() == []


def test_last_unit_is_drawn_at_random(spark):
    rec = records(spark, {"A": 3, "B": 3})
    cal = calibrate.calibrated_plans(rec, plans(spark, [x for p in range(400) for x in ((p, "g", "A", 0.5, 1, 0), (p, "g", "B", 0.5, 1, 0))]))
    n = calibrate.pivotal_sample(rec, cal.withColumn("probability", F.lit(0.1))).count()
    assert abs(n - 240) < 60


def test_labels(spark):
    df = spark.createDataFrame([("WEB ATTACK \u0096  XSS",), (" benign\t",), (None,), ("a�b",)], "t string")
    assert [r[0] for r in df.select(calibrate.normalized_label(F.col("t"))).collect()] == ["web attack - xss", "benign", None, "a - b"]


def test_tokens(spark):
    texts = ["", None, "  \n ", "a_b c-d", "Größe über 5,3 %", "x" * 100_000, "été…!? 中文", "a b c"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(token_count(F.col("t"))).collect()]
    assert got == [len(re.findall(r"\w+|[^\w\s]+", t or "")) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=200), st.integers(30, 60))
def test_sum_of_squares_rule(sizes, cap):
    boxes = packing.sum_of_squares(np.array(sizes, np.int64), cap)
    level: dict[int, int] = {}
    for s, b in zip(sizes, boxes.tolist()):
        open_: dict[int, int] = {}
        for v in level.values():
            if v < cap:
                open_[cap - v] = open_.get(cap - v, 0) + 1

        def after(gap, s=s, open_=open_):
            n = dict(open_)
            if gap < cap:
                n[gap] -= 1
            if gap > s:
                n[gap - s] = n.get(gap - s, 0) + 1
            return sum(x * x for x in n.values())

        best = min(after(g) for g in [*[g for g in open_ if g >= s], cap])
        assert after(cap - level.get(b, 0)) == best
        level[b] = level.get(b, 0) + s
        assert level[b] <= cap


def test_packing(spark):
    rng = np.random.default_rng(1)
    data = [(i, " ".join(["w"] * int(n)), str(rng.choice([" EN ", "de", "xx"]))) for i, n in enumerate(rng.integers(1, 60, 600))] + [(600, "w " * 205, "en"), (601, "w " * 200, "en"), (602, None, "en"), (603, "  ", None), (604, "w " * 31, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("capacity", F.lit("x")).withColumn("chunk", F.lit(0))
    box = spark.createDataFrame([("en", 100), ("de", 80), ("und", 30)], "lang string, capacity int")
    for chunk in (packing.CHUNK, 50):
        got = packing.pack_documents(docs, box, chunk=chunk).toPandas()
        full = got[got.container.notna()]
        assert (full.groupby("container").tokens.sum() <= full.groupby("container").capacity.first()).all()
        sizes = got.groupby("doc_id").tokens.sum()
        assert all(sizes[i] == len((t or "").split()) for i, t, _ in data)
        pieces = got[got.tokens > 0].groupby("doc_id").size()
        cap = got.groupby("doc_id").capacity.first()
        assert all(pieces[i] == -(-sizes[i] // cap[i]) for i in pieces.index)
        assert got[got.doc_id == 600].tokens.tolist().count(100) == 2 and set(got[got.doc_id.isin([602, 603])].container.isna()) == {True}
        assert set(got[got.doc_id == 604].lang) == {"und"}
        if chunk == packing.CHUNK:
            rep = packing.packing_report(packing.pack_documents(docs, box)).toPandas()
            assert (rep.containers >= rep.least_containers).all() and rep[rep.lang == "en"].unused.iloc[0] < 0.12
    assert packing.pack_documents(docs.limit(0), box).collect() == []


def test_chunks_waste_no_more_than_one_chunk(spark):
    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(i, "w " * int(n), "en") for i, n in enumerate(rng.integers(1, 60, 3000))] + [(0, "w w", "en")], "doc_id long, text string, lang string")
    box = spark.createDataFrame([("en", 100), ("und", 30)], "lang string, capacity int")
    used = {}
    for chunk in (packing.CHUNK, 200):
        got = packing.pack_documents(docs, box, chunk=chunk).toPandas()
        assert len(got) == 3001 and got.groupby("container").tokens.sum().max() <= 100
        used[chunk] = got.container.nunique()
    assert used[200] <= 1.01 * used[packing.CHUNK]  # 15 chunks cost no more than a hundredth


@pytest.fixture
def sources(spark):
    rng = np.random.default_rng(2)
    data = [(i, " ".join(["w"] * int(n)), s) for i, (n, s) in enumerate(zip(rng.integers(1, 40, 500), rng.choice(["Big ", "big", "small"], 500, p=[0.6, 0.3, 0.1])))]
    return data + [(500, "w", None), (501, None, "big"), (502, "", "empty"), (503, "w w", "one")]


def test_mixing(spark, sources):
    docs = spark.createDataFrame(sources, "doc_id long, text string, source string").withColumn("place", F.lit(1)).withColumn("copies", F.lit(2))
    t = spark.createDataFrame([(1, "BIG", 0.7, 2, 4000), (1, "small", 0.3, 3, 4000), (2, "small", 1.0, 1, 10**6), (3, "empty", 0.5, 4, 100), (3, "gone", 0.4, 4, 100), (3, "one", 0.1, 4, 100), (4, None, None, None, None)], "mix_no int, source string, target_share double, max_repeats int, total_tokens long")
    docs = mixing.sized_documents(docs)
    rates = mixing.mix_rates(docs, t).cache()
    short = mixing.mix_report(rates, mixing.mixed_documents(docs, rates)).where("short")
    assert {(r["mix_no"], r["source"]) for r in short.collect()} == {(2, "small"), (3, "empty"), (3, "gone"), (3, "one")}
    for seed in (3, 4):
        got = mixing.mixed_documents(docs, rates, seed=seed).toPandas()
        small = sum(len(x.split()) for _, x, s in sources if s == "small")
        most = max(len(x.split()) for _, x, s in sources if x)
        reached = (got.tokens * got.copies).groupby([got.mix_no, got.source]).sum()
        assert abs(reached[(1, "big")] - 2800) <= 2 * most and abs(reached[(1, "small")] - 1200) <= 2 * most
        assert reached[(2, "small")] == small and got[got.mix_no == 2].copies.max() == 1
        assert reached[(3, "one")] == 8
        assert got[(got.mix_no == 1) & (got.source == "big")].copies.max() <= 2
        assert not got.duplicated(["mix_no", "source", "doc_id"]).any()
    rep = mixing.mix_report(rates, mixing.mixed_documents(docs, rates)).where("mix_no = 1 and source = 'BIG'").first()
    assert abs(rep["share_reached"] - 0.7) < 0.03
    assert mixing.mixed_documents(docs.limit(0), mixing.mix_rates(docs.limit(0), t)).collect() == []


def test_places_follow_size_in_blocks(spark, sources):
    docs = spark.createDataFrame([*sources, sources[0], sources[0]], "doc_id long, text string, source string")
    for block in (mixing.BLOCK, 2):
        got = mixing.placed_documents(mixing.sized_documents(docs), block=block).where("source = 'big'").orderBy("place").toPandas()
        assert got.place.tolist() == list(range(1, len(got) + 1)) and got.tokens.is_monotonic_increasing


def test_copies_are_systematic(spark):
    """Every document of a source is taken floor or ceil of its expected copies, and all together as often as expected."""
    docs = mixing.sized_documents(spark.createDataFrame([(i, "w", "s") for i in range(97)], "doc_id long, text string, source string"))
    t = spark.createDataFrame([(m, "s", 1.0, 5, 13 * m + 1) for m in range(30)], "mix_no int, source string, target_share double, max_repeats int, total_tokens long")
    got = mixing.mixed_documents(docs, mixing.mix_rates(docs, t)).toPandas()
    for m in range(30):
        want = min(13 * m + 1, 5 * 97)
        c = got[got.mix_no == m].set_index("doc_id").copies.reindex(range(97), fill_value=0)
        assert abs(c.sum() - want) <= 1 and c.min() >= int(want / 97 - 1e-9) and c.max() <= -(-want // 97)
