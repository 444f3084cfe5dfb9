"""Exact and near copies of records across splits, by an edit-distance segment join.

A record is read as a string with one symbol per field. Of k + 1 segments of an evaluation string, at least one is
untouched by the at most k edits that turn it into a training string, and so is a substring of that one; for strings
of equal length, segment i (from 1) lies there at most min(i - 1, k + 1 - i) places off, for one such segment at least.
So equal segments at the allowed positions give every candidate. A symbol is the cell of a value on a logarithmic grid;
values within the tolerance may lie in adjoining cells, so evaluation strings also look into the adjoining cell wherever
a value is that near to its cell's edge. Candidates are verified by banded dynamic programming on the values; the
field-by-field rule, where it is wanted, follows.

A segment value that very many rows share is cut again: of k + 1 pieces of the rest of the string one is untouched, too,
at most k / 2 places off, and the pair must share this piece beside the segment. Which values are that frequent is counted
beforehand, level by level, until none is or no more than k fields are left. Copies that agree in every bit are joined once, through one representative, and
results are links between classes of such copies plus the records' membership; pairs are expanded from these.

Symbols and hashes are computed on Arrow batches: as column expressions, 22 fields with three cells each make methods
too large for the JIT compiler and took ten times the CPU seconds.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.session import stored

#: Width of a symbol's cell in natural logarithms.
CELL = 0.05
#: Most buckets of frequent segment values that are sent to all tasks (8 bytes each); beyond, only more frequent ones are cut again.
MOST_HOT = 1 << 22


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def cut(fields: Sequence[int], parts: int) -> list[tuple[int, int]]:
    """Cut rising field numbers into at least ``parts`` runs (from, to) of neighbours, of sizes as equal as runs allow.

    Fewer come out only if there are fewer fields.
    """
    runs: list[list[int]] = []
    for j in fields:
        if runs and runs[-1][-1] == j - 1:
            runs[-1].append(j)
        else:
            runs.append([j])
    pieces = [(r[0], r[-1] + 1) for r in runs]
    counts = [1] * len(pieces)
    while sum(counts) < min(parts, len(fields)):
        sizes = [(b - a) / c if b - a > c else 0 for (a, b), c in zip(pieces, counts)]
        counts[sizes.index(max(sizes))] += 1
    out = []
    for (a, b), c in zip(pieces, counts):
        edges = [a + (b - a) * i // c for i in range(c + 1)]
        out += list(zip(edges[:-1], edges[1:]))
    return out


def banded_distance(a: np.ndarray, b: np.ndarray, band: int, rel_tol: float) -> np.ndarray:
    """Edit distance of rows of a and b (pairs x fields), exact up to ``band`` and band + 1 beyond.

    NaN stands for a missing or infinite value and equals itself only; other values are equal within rel_tol.
    """
    n, m = a.shape
    worst = band + 1
    prev = np.full((n, 2 * band + 1), worst, np.int16)
    for d in range(band + 1):
        prev[:, band + d] = d
    for i in range(1, m + 1):
        cur = np.full_like(prev, worst)
        for d in range(-band, band + 1):
            j = i + d
            if j < 0 or j > m:
                continue
            if j == 0:
                cur[:, band + d] = min(i, worst)
                continue
            x, y = a[:, i - 1], b[:, j - 1]
            with np.errstate(invalid="ignore"):
                same = (np.isnan(x) & np.isnan(y)) | (np.abs(x - y) <= rel_tol * np.maximum(np.abs(x), np.abs(y)))
            best = prev[:, band + d] + ~same
            if d > -band:
                best = np.minimum(best, cur[:, band + d - 1] + 1)
            if d < band:
                best = np.minimum(best, prev[:, band + d + 1] + 1)
            cur[:, band + d] = np.minimum(best, worst)
        prev = cur
    return prev[:, band]


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Fold 64-bit values into 64-bit hashes (multiply and shift, as in splitmix64)."""
    h = (h ^ x.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def canonical(columns: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Doubles with one NaN for all that is missing (null, NaN, infinite) and one zero."""
    out = []
    for c in columns:
        x = np.asarray(c, dtype=np.float64)
        out.append(np.where(np.isfinite(x), x + 0.0, np.nan))
    return out


def fingerprints(x: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits per record, as two columns."""
    n = len(x[0])
    one, two = np.full(n, 1, np.uint64), np.full(n, 2, np.uint64)
    for c in x:
        one = _mix(one, c)
    for c in reversed(x):
        two = _mix(two, c)
    return one.view(np.int64), two.view(np.int64)


def cells(x: np.ndarray, rel_tol: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each value, and the adjoining one that values within rel_tol may lie in (else the cell itself)."""
    tol = -math.log1p(-rel_tol) / CELL * (1 + 1e-9) + 1e-9
    missing, zero = np.isnan(x), x == 0
    y = np.log(np.where(missing | zero, 1.0, np.abs(x))) / CELL
    low = np.floor(y)
    frac = y - low
    step = np.where(frac <= tol, -1, np.where(frac >= 1 - tol, 1, 0))
    sign = np.where(x < 0, -1, 1)
    own = (low.astype(np.int64) + 10_000_000) * sign
    other = own + step * sign
    for special, code in ((missing, -1), (zero, 0)):
        own, other = np.where(special, code, own), np.where(special, code, other)
    return own, other


def segment_keys(codes: Sequence[tuple[np.ndarray, np.ndarray]], fields: Sequence[int], rows: np.ndarray, seeds: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the fields' symbols for each row; rows with probe also get every combination with adjoining cells."""
    for j in fields:
        own, other = (c[rows] for c in codes[j])
        also = np.flatnonzero(probe[rows] & (own != other))
        keys = _mix(seeds, own)
        if len(also):
            keys = np.concatenate([keys, _mix(seeds[also], other[also])])
            rows = np.concatenate([rows, rows[also]])
        seeds = keys
    return rows, seeds


class _Keys:
    """The keys under which records meet: segments of evaluation records, and substrings of training records."""

    def __init__(self, fields: int, k: int):
        self.fields, self.k = fields, k

    def pieces(self, matched: tuple[tuple[int, int], ...]) -> list[tuple[int, int, int]]:
        """(from, to, places off) of the pieces of what is not matched yet."""
        rest = [j for j in range(self.fields) if not any(a <= j < b for a, b in matched)]
        got = cut(rest, self.k + 1)
        if matched:
            return [(a, b, self.k // 2) for a, b in got]
        return [(a, b, min(i, self.k - i)) for i, (a, b) in enumerate(got)]

    def all(self, codes: Sequence[tuple[np.ndarray, np.ndarray]], rows: np.ndarray, evaluation: bool, hot: Sequence[tuple[int, np.ndarray]], level: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, key) of the rows, which are all of one side.

        hot: per level the number of bits and the sorted buckets of keys that are cut again; with ``level`` only keys of that
        level are given, else all that are not cut again.
        """

        def walk(rows: np.ndarray, seeds: np.ndarray, matched: tuple[tuple[int, int], ...], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for n, (a, b, off) in enumerate(self.pieces(matched)):
                for shift in (0,) if evaluation else range(-off, off + 1):
                    if a + shift < 0 or b + shift > self.fields:
                        continue
                    at, keys = segment_keys(codes, range(a + shift, b + shift), rows, _mix(seeds, np.full(len(rows), n + 1, np.int64)), np.full(len(codes[0][0]), evaluation))
                    after = (*matched, (a, b))
                    last = self.fields - sum(y - x for x, y in after) <= self.k  # so few fields may all differ
                    if depth < len(hot) and not last:
                        bits, full = hot[depth]
                        again = np.isin(keys & np.uint64((1 << bits) - 1), full)
                        if again.any():
                            yield from walk(at[again], keys[again], after, depth + 1)
                        at, keys = at[~again], keys[~again]
                    if (level is None or depth == level) and len(at):
                        yield at, keys

        if len(rows):
            yield from walk(rows, np.full(len(rows), 0, np.uint64), (), 0)


def _hot_buckets(counts: DataFrame, hot_rows: int) -> np.ndarray:
    """Sorted buckets of more than hot_rows rows; of more than a multiple of that, if they were more than MOST_HOT."""
    got = counts.where(F.col("n") > hot_rows).select("bucket").limit(MOST_HOT + 1).collect()
    if len(got) > MOST_HOT:
        return _hot_buckets(counts, 2 * hot_rows)
    return np.sort(np.array([r[0] for r in got], np.uint64))


def near_record_links(
    df: DataFrame,
    *,
    features: Sequence[str],
    id_col: str = "flow_id",
    split_col: str = "split",
    train: Sequence[str] = ("train",),
    evaluation: Sequence[str] = ("val", "test"),
    edits: int = 2,
    rel_tol: float = 1e-3,
    hot_rows: int = 20_000,
) -> tuple[DataFrame, DataFrame]:
    """Links (a1, a2, b1, b2, distance, agreeing) between classes of equal training and evaluation records, and members (id, side, f1, f2).

    A class is named by the two halves of its fingerprint; side is 1 for training and 2 for evaluation records. Classes
    are linked if at most ``edits`` values must be changed, put in or taken out to turn one record into the other; agreeing
    is the number of fields that agree where they stand. Two values agree if both are missing (null, NaN or infinite) or
    ``|x - y| <= rel_tol * max(|x|, |y|)`` in double. Rows with a null id or of no listed split take no part; repeated rows
    count by their ids; columns other than the named ones are not read, whatever their names; an empty table gives no links.
    A segment value that more than ``hot_rows`` rows share is cut again, which loses no pair.
    """
    m, k = len(features), edits
    if not 0 <= k < m:
        raise ValueError("edits must be at least 0 and fewer than the features")
    keys_of = _Keys(m, k)
    side = F.when(_q(split_col).isin(*train), F.lit(1)).when(_q(split_col).isin(*evaluation), F.lit(2))
    base = df.select(_q(id_col).cast("long").alias("id"), side.cast("tinyint").alias("side"), *[_q(c).cast("double").alias(f"v{j}") for j, c in enumerate(features)]).where("id is not null and side is not null")

    def read(batch: pa.RecordBatch) -> list[np.ndarray]:
        return canonical([batch.column(f"v{j}").to_numpy(zero_copy_only=False) for j in range(m)])

    def sides_of(batch: pa.RecordBatch) -> list[tuple[np.ndarray, bool]]:
        who = batch.column("side").to_numpy()
        return [(np.flatnonzero(who == 1), False), (np.flatnonzero(who == 2), True)]

    # buckets grow with the data, so that a bucket of rare keys holds a sixteenth of hot_rows on average
    bits = max(18, math.ceil(math.log2(max(1, 16 * (k + 1) * base.count() / hot_rows))))
    hot: list[tuple[int, np.ndarray]] = []
    while len(hot) < m:

        def count(batches: Iterable[pa.RecordBatch], level: int = len(hot)) -> Iterator[pa.RecordBatch]:
            dense = np.zeros(1 << bits, np.int64) if bits <= 20 else None
            mask = np.uint64((1 << bits) - 1)
            for batch in batches:
                codes = [(c := cells(x, rel_tol)[0], c) for x in read(batch)]
                found = [(key & mask).astype(np.int64) for rows, ev in sides_of(batch) for _, key in keys_of.all(codes, rows, ev, hot, level)]
                if not found:
                    continue
                if dense is not None:
                    dense += np.bincount(np.concatenate(found), minlength=len(dense))
                else:
                    at, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["bucket", "n"])
            if dense is not None:
                at = np.flatnonzero(dense)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(dense[at])], names=["bucket", "n"])

        full = _hot_buckets(base.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")), hot_rows)
        if not len(full):
            break
        hot.append((bits, full))

    def all_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = read(batch)
            codes = [cells(c, rel_tol) for c in x]
            ids, fp = batch.column("id").to_numpy(), fingerprints(x)[0]
            parts = [(at, key, np.full(len(at), 2 if ev else 1, np.int8)) for rows, ev in sides_of(batch) for at, key in keys_of.all(codes, rows, ev, hot)]
            if not parts:
                continue
            at, keys, w = (np.concatenate(c) for c in zip(*parts))
            # copies within the batch become one line before the shuffle
            order = np.lexsort((fp[at], keys))
            keys, f, i, w = keys[order], fp[at][order], ids[at][order], w[order]
            first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (f[1:] != f[:-1])]))
            out = [keys[first].view(np.int64), f[first], np.minimum.reduceat(i, first), np.bitwise_or.reduceat(w, first)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["key", "fp", "rep", "sides"])

    # equal records share a line; the exchange on the key serves both the grouping and the join
    keyed = base.mapInArrow(all_keys, "key long, fp long, rep long, sides tinyint")
    lines = keyed.repartition("key").groupBy("key", "fp").agg(F.min("rep").alias("rep"), F.bit_or("sides").alias("sides"))
    sided = lambda bit, name: lines.where(F.col("sides").bitwiseAND(F.lit(bit)) != 0).select("key", F.col("rep").alias(name))
    candidates = sided(1, "a").join(sided(2, "b"), "key").select("a", "b").distinct()

    both_ends = F.array(F.struct(F.lit(0).alias("end"), F.col("a").alias("id")), F.struct(F.lit(1).alias("end"), F.col("b").alias("id")))
    ends = candidates.select("a", "b", F.explode(both_ends).alias("p")).select("a", "b", "p.end", "p.id")
    fetched = ends.join(base.select("id", F.array(*[f"v{j}" for j in range(m)]).alias("x")), "id")
    first = lambda e: F.first(F.when(F.col("end") == e, F.col("x")), ignorenulls=True)
    pairs = fetched.groupBy("a", "b").agg(first(0).alias("p"), first(1).alias("q")).select("p", "q")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.array(canonical(batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, m).T)).T for c in ("p", "q"))
            distance = banded_distance(a, b, k, rel_tol)
            near = distance <= k
            a, b = a[near], b[near]
            with np.errstate(invalid="ignore"):
                same = (np.isnan(a) & np.isnan(b)) | (np.abs(a - b) <= rel_tol * np.maximum(np.abs(a), np.abs(b)))
            marks = [*fingerprints([np.ascontiguousarray(c) for c in a.T]), *fingerprints([np.ascontiguousarray(c) for c in b.T])]
            yield pa.RecordBatch.from_arrays([*map(pa.array, marks), pa.array(distance[near].astype(np.int32)), pa.array(same.sum(1).astype(np.int32))], names=["a1", "a2", "b1", "b2", "distance", "agreeing"])

    links = pairs.mapInArrow(verify, "a1 long, a2 long, b1 long, b2 long, distance int, agreeing int").dropDuplicates(["a1", "a2", "b1", "b2"])

    def marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("side"), *map(pa.array, fingerprints(read(batch)))], names=["id", "side", "f1", "f2"])

    return links, base.mapInArrow(marked, "id long, side tinyint, f1 long, f2 long")


def near_record_overlaps(df: DataFrame, *, features: Sequence[str], min_agree: int = 20, same_fields: bool = True, **how: object) -> DataFrame:
    """All pairs (train_id, eval_id, agreeing) of a training and an evaluation record within len(features) - min_agree edits.

    With ``same_fields`` only those that agree in min_agree fields where they stand. Options as in near_record_links.
    """
    links, members = near_record_links(df, features=features, edits=len(features) - min_agree, **how)
    if same_fields:
        links = links.where(F.col("agreeing") >= min_agree)
    t = members.where("side = 1").select(F.col("f1").alias("a1"), F.col("f2").alias("a2"), F.col("id").alias("train_id"))
    e = members.where("side = 2").select(F.col("f1").alias("b1"), F.col("f2").alias("b2"), F.col("id").alias("eval_id"))
    return links.join(t, ["a1", "a2"]).join(e, ["b1", "b2"]).select("train_id", "eval_id", "agreeing")


def near_record_classes(df: DataFrame, *, features: Sequence[str], min_agree: int = 20, **how: object) -> DataFrame:
    """(id, side, class_id, links, partners, agreeing): each training and evaluation record with its class of equal records.

    class_id is the lowest id of the class, whatever its splits; links counts the classes of the other side that agree in
    min_agree fields, partners their records of that side (the pairs of the record), agreeing is the best of them. No pair
    is expanded.
    """
    links, members = near_record_links(df, features=features, edits=len(features) - min_agree, **how)
    links, members = stored(links.where(F.col("agreeing") >= min_agree)), stored(members)
    sizes = members.groupBy("f1", "f2").agg(F.min("id").alias("class_id"), F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == 2).alias("n2"))

    def seen_from(own: str, other: str, n: str) -> DataFrame:
        far = sizes.select(F.col("f1").alias(f"{other}1"), F.col("f2").alias(f"{other}2"), F.col(n).alias("n"))
        per = links.join(far, [f"{other}1", f"{other}2"]).groupBy(F.col(f"{own}1").alias("f1"), F.col(f"{own}2").alias("f2"))
        return per.agg(F.count("*").alias("links"), F.sum("n").alias("partners"), F.max("agreeing").alias("agreeing")).withColumn("side", F.lit(1 if own == "a" else 2).cast("tinyint"))

    found = seen_from("a", "b", "n2").unionByName(seen_from("b", "a", "n1"))
    out = members.join(sizes.select("f1", "f2", "class_id"), ["f1", "f2"]).join(found, ["f1", "f2", "side"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("id", "side", "class_id", zero("links"), zero("partners"), "agreeing")


def overlap_report(df: DataFrame, classes: DataFrame, *, id_col: str = "flow_id", by: Sequence[str] = ("split", "label", "source_file")) -> DataFrame:
    """Per group: its records, those with partners on the other side, the pairs, and the most fields in which one agrees.

    classes: of near_record_classes. Null group values form a group of their own. Groups without overlaps are kept, with
    zeros.
    """
    found = classes.where("partners > 0").select(F.col("id").alias("__id"), F.col("partners").alias("__n"), F.col("agreeing").alias("__best")).dropDuplicates(["__id"])
    most = df.select(_q(id_col).alias("__id"), *[_q(c).alias(f"g{n}") for n, c in enumerate(by)])
    joined = most.join(found, "__id", "left")
    return joined.groupBy(*[F.col(f"g{n}").alias(c) for n, c in enumerate(by)]).agg(
        F.count("*").alias("records"),
        F.count("__n").alias("overlapping"),
        F.coalesce(F.sum("__n"), F.lit(0)).alias("pairs"),
        F.max("__best").alias("most_agreeing"),
    )
