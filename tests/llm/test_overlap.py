"""Exact and near copies of records against a comparison of all pairs."""

import math

import numpy as np
import pytest
from conftest import rows

from flowquarry.llm import overlap

NAN, INF = float("nan"), float("inf")
NAMES = ["a b", "c/s", "d.1", "e", "f", "g", "h"]


def agree(x, y, tol=1e-3):
    bad = lambda v: v is None or math.isnan(v) or math.isinf(v)
    if bad(x) or bad(y):
        return bad(x) and bad(y)
    return abs(x - y) <= tol * max(abs(x), abs(y))


def all_pairs(data, least):
    t, e = [r for r in data if r[1] == "train"], [r for r in data if r[1] in ("val", "test")]
    return sorted((a[0], b[0], n) for a in t for b in e for n in [sum(agree(x, y) for x, y in zip(a[2:], b[2:]))] if n >= least and a[0] is not None and b[0] is not None)


def frame(spark, data):
    return spark.createDataFrame(data, "flow_id long, split string, " + ", ".join(f"`{n}` double" for n in NAMES))


def noisy(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.lognormal(3, 3, (n // 3, 7)) * rng.choice([1, -1], (n // 3, 7), p=[0.9, 0.1])
    out = []
    for i in range(n):
        x = base[rng.integers(len(base))].copy()
        x *= 1 + rng.choice([0, 0.0009, -0.0009, 0.00101, 0.5], 7, p=[0.4, 0.2, 0.2, 0.1, 0.1])
        x[rng.random(7) < 0.05] = rng.choice([0.0, -0.0, NAN, INF, -INF, -1.0, 443.0])
        v = [None if rng.random() < 0.02 else float(f) for f in x]
        out.append((i, str(rng.choice(["train", "val", "test", "other"], p=[0.55, 0.2, 0.2, 0.05])), *v))
    return out


@pytest.mark.parametrize("seed,least,hot", [(1, 5, 20_000), (2, 5, 3), (3, 6, 2), (4, 7, 20_000), (5, 4, 5)])
def test_against_all_pairs(spark, seed, least, hot):
    data = noisy(seed, 180)
    got = overlap.near_record_overlaps(frame(spark, data), features=NAMES, min_agree=least, hot_rows=hot)
    assert rows(got) == sorted(all_pairs(data, least), key=lambda t: tuple(map(lambda x: (False, str(x)), t)))


def test_copies_ties_nulls_and_other_columns(spark):
    same = (1.0, 2.0, 0.0, None, NAN, INF, -1.0)
    data = [(i, "train" if i < 30 else "test", *same) for i in range(50)] + [(50, "test", 1.0, 2.0, -0.0, NAN, None, -INF, -1.0), (51, "val", 1.0009, 2.0, 0.0, None, None, None, 5.0), (None, "train", *same), (52, None, *same), (53, "train", *[None] * 7), (54, "val", *[NAN] * 7)]
    df = frame(spark, data).selectExpr("*", "'x' as id", "'y' as side", "1 as key", "2 as fp")
    got = overlap.near_record_overlaps(df, features=NAMES, min_agree=6, hot_rows=10)
    assert rows(got) == sorted(all_pairs(data, 6), key=lambda t: tuple((False, str(x)) for x in t))
    assert overlap.near_record_overlaps(df.limit(0), features=NAMES, min_agree=6).count() == 0


def test_report(spark):
    data = [(1, "train", *[1.0] * 7), (2, "test", *[1.0] * 7), (3, "test", *[1.0] * 6, 9.0), (4, "test", *[7.0] * 7), (5, "val", *[8.0] * 7)]
    df = frame(spark, data)
    rep = {r["split"]: (r["records"], r["overlapping"], r["pairs"], r["most_agreeing"]) for r in overlap.overlap_report(df, overlap.near_record_classes(df, features=NAMES, min_agree=6), by=["split"]).collect()}
    assert rep["test"] == (3, 2, 2, 7) and rep["val"] == (1, 0, 0, None)


def edit_distance(x, y):
    d = list(range(len(y) + 1))
    for i, a in enumerate(x):
        new = [i + 1]
        for j, b in enumerate(y):
            new.append(min(d[j] + (not agree(a, b)), d[j + 1] + 1, new[j] + 1))
        d = new
    return d[-1]


@pytest.mark.parametrize("hot", [20_000, 4])
def test_shifted_records_against_all_edit_distances(spark, hot):
    """Values put in, taken out and changed: the dynamic programme decides, and the field rule keeps fewer."""
    data = []
    for i, (no, split, *v) in enumerate(noisy(11, 160)):
        if i % 3 == 0 and data:
            v = list(data[i // 2][2:])
            v = ([7.5, *v[:-1]], [*v[1:], 7.5], [*v[:2], *v[3:], -3.0], [v[0], 9.0, *v[1:-1]])[i % 4]
        data.append((no, split, *v))
    got = overlap.near_record_overlaps(frame(spark, data), features=NAMES, min_agree=5, same_fields=False, hot_rows=hot)
    t, e = [r for r in data if r[1] == "train"], [r for r in data if r[1] in ("val", "test")]
    want = {(a[0], b[0]) for a in t for b in e if edit_distance(b[2:], a[2:]) <= 2}
    found = {(r["train_id"], r["eval_id"]) for r in got.collect()}
    assert found == want
    strict = {(a, b) for a, b, _ in all_pairs(data, 5)}
    assert strict < found


def test_pieces():
    assert overlap.cut(range(22), 3) == [(0, 7), (7, 14), (14, 22)]
    assert overlap.cut([0, 1, 2, 7, 8, 9, 10, 11], 3) == [(0, 3), (7, 9), (9, 12)]
    assert overlap.cut([3], 3) == [(3, 4)] and overlap.cut([], 3) == []
    k = overlap._Keys(22, 2)
    assert k.pieces(()) == [(0, 7, 0), (7, 14, 1), (14, 22, 0)]
    assert k.pieces(((7, 14),)) == [(0, 7, 1), (14, 18, 1), (18, 22, 1)]


def test_one_record_in_a_tenth_of_the_rows_and_one_value_in_a_third(spark):
    """A frequent record, and frequent first fields: values are cut again until they are rare, and nothing is lost."""
    rng = np.random.default_rng(12)
    data = []
    for i in range(900):
        v = rng.lognormal(3, 2, 7)
        if i % 10 == 0:
            v = np.array([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0])
        elif i % 3 == 0:
            v[:5] = [1.0, 2.0, 3.0, 4.0, 5.0]
        elif i % 3 == 1:
            v[2:5] = 0.0
        data.append((i, ("train", "val", "test")[i % 7 % 3], *map(float, v)))
    df = frame(spark, data)
    got = overlap.near_record_overlaps(df, features=NAMES, min_agree=5, hot_rows=20)
    assert rows(got) == sorted(all_pairs(data, 5), key=lambda t: tuple((False, str(x)) for x in t))
    per = {}
    for a, b, _ in all_pairs(data, 5):
        per[a], per[b] = per.get(a, 0) + 1, per.get(b, 0) + 1
    classes = {r["id"]: r for r in overlap.near_record_classes(df, features=NAMES, min_agree=5, hot_rows=20).collect()}
    assert {i: r["partners"] for i, r in classes.items() if r["partners"]} == per and len(classes) == len(data)
    assert {r["class_id"] for i, r in classes.items() if i % 10 == 0} == {0} and classes[1]["class_id"] == 1


def test_banded_distance():
    rng = np.random.default_rng(7)

    def plain(x, y):
        d = np.arange(len(y) + 1)
        for i, a in enumerate(x):
            new = [i + 1]
            for j, b in enumerate(y):
                new.append(min(d[j] + (a != b), d[j + 1] + 1, new[j] + 1))
            d = new
        return d[-1]

    a = rng.integers(1, 4, (300, 9)).astype(float)
    b = a.copy()
    b[rng.random(b.shape) < 0.2] = 3.0
    b = np.where(rng.random((300, 1)) < 0.5, np.roll(b, 1, axis=1), b)
    for band in (1, 2, 3):
        got = overlap.banded_distance(a, b, band, 1e-3)
        assert got.tolist() == [min(plain(x, y), band + 1) for x, y in zip(a, b)]


def test_cells_of_agreeing_values_meet():
    rng = np.random.default_rng(8)
    x = rng.lognormal(0, 5, 200_000) * rng.choice([1, -1], 200_000)
    y = x * (1 + rng.uniform(-0.001, 0.001, len(x)))
    near = np.abs(x - y) <= 1e-3 * np.maximum(np.abs(x), np.abs(y))
    own, other = overlap.cells(x, 1e-3)
    of_y, _ = overlap.cells(y, 1e-3)
    assert (((own == of_y) | (other == of_y)) | ~near).all()
