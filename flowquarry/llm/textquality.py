"""Statistics of each document's text, their exact ranks per language, and what they say together.

Ranks come from a sort over ranges of (statistic, language, value): each range counts on its own, the counts of the
ranges before it are added as an offset, and values that lie at the edge of a range take their ties from its neighbours.
A value that very many documents share is spread over ranges by the documents. The empirical tail probabilities of a
document's statistics are combined to an outlier score, which decides what is no prose: its weights come from labelled
documents, by logistic regression.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.llm.textstats import STATISTICS, Tokens, block_statistics, blocks, common_table
from flowquarry.llm.tokens import plain_key
from flowquarry.session import stored

#: Most labelled documents that are used: one half teaches pairs of tokens, the other the weights of the tails.
MOST_LABELLED = 4000


def labelled_sample(labels: DataFrame, most: int = MOST_LABELLED) -> list[tuple]:
    """(doc_id, the readers' share of "not prose", half) of at most ``most`` labelled documents, by the hash of their ids."""
    per = labels.where("doc_id is not null and prose is not null").groupBy("doc_id").agg((1 - F.avg("prose")).alias("junk"))
    got = per.orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(most).collect()
    return [(r["doc_id"], float(r["junk"]), n % 2) for n, r in enumerate(got)]


def _with_text(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").rlike(r"\S"))


def prose_pairs(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """Sorted hashes of the pairs of tokens that are more usual in the sampled prose than in the other sampled documents.

    sample: (doc_id, junk), of bounded size. A pair counts once per document; it is kept if its share of the prose
    documents is more than half of its share of the others.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, junk in zip(b.column("text"), b.column("junk").to_pylist()):
                got = np.unique(Tokens(pa.array([text.as_py()])).pairs()).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(np.full(len(got), junk <= 0.5))], names=["pair", "prose"])

    some = _with_text(docs.select("doc_id", "text")).join(F.broadcast(sample), "doc_id").select("text", "junk")
    per = some.mapInArrow(run, "pair long, prose boolean").groupBy("pair").agg(F.count_if("prose").alias("yes"), F.count_if(~F.col("prose")).alias("no"))
    total = sample.select(F.count_if(F.col("junk") <= 0.5).alias("y"), F.count_if(F.col("junk") > 0.5).alias("n")).first()
    kept = per.where(F.col("yes") * 2.0 * max(total["n"], 1) > F.col("no") * float(max(total["y"], 1))).where("yes > 0").select("pair").toPandas()
    return np.sort(kept["pair"].to_numpy(np.int64).view(np.uint64))


def document_statistics(docs: DataFrame, common: DataFrame, pairs: np.ndarray) -> DataFrame:
    """(row, doc_id, language, statistics...): one row per document whose text isn't null or blank.

    Texts are read whole. Repeated documents keep a row each. pairs: sorted hashes of the pairs that prose has.
    """
    words_of: dict[str, set[str]] = {}
    for r in common.select(plain_key(F.col("lang")).alias("lang"), F.lower("word").alias("word")).where("lang is not null and word is not null").collect():  # of fixed size
        words_of.setdefault(r["lang"], set()).add(r["word"])
    shared = docs.sparkSession.sparkContext.broadcast((common_table(words_of), pairs))  # plain arrays: a table of fixed size, and pairs of the bounded sample
    rows = _with_text(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", plain_key(F.col("lang")).alias("lang"), "text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = shared.value
        for b in batches:
            texts, langs = b.column("text"), b.column("lang").to_pylist()
            for i, j in blocks(texts):
                names, x = block_statistics(texts.slice(i, j - i), langs[i:j], table, known)
                yield pa.RecordBatch.from_arrays([b.column("row").slice(i, j - i), b.column("doc_id").slice(i, j - i), pa.array(names, pa.string()), *(pa.array(c) for c in x.T)], names=["row", "doc_id", "language", *STATISTICS])

    return rows.mapInArrow(run, f"row long, doc_id {kind}, language string, " + ", ".join(f"{s} double" for s in STATISTICS))


def exact_tails(long: DataFrame, by: Sequence[str], value: str, tie: str) -> DataFrame:
    """The rows of long with at_most and at_least: the shares of the rows of the same keys with at most, at least their value.

    tie: a column that parts rows of equal value, so that no range of the sort holds all rows of a frequent value.
    """
    keys = [*by, value]
    ranged = long.repartitionByRange(*keys, tie).sortWithinPartitions(*keys, tie)
    names = long.columns

    def differs(c: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, first = TaskContext.get().partitionId(), 0, True
        held: pa.Table | None = None  # the rows of the last value, which may go on; before: rows of its keys ahead of it

        def flush(t: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal before, held, first
            n = t.num_rows
            new_key, new_run = np.zeros(n, bool), np.zeros(n, bool)
            new_run[0] = True
            for c in by:
                new_key[1:] |= differs(t.column(c).chunk(0))
            new_run[1:] = new_key[1:] | differs(t.column(value).chunk(0))
            at = np.flatnonzero(new_run)
            size = np.diff(np.append(at, n))
            base = np.maximum.accumulate(np.where(new_key, np.arange(n), -before))[at]  # a key that goes on began before this table
            start = at - base
            edge = np.zeros(len(at), bool)
            edge[0] = first
            edge[-1] |= last
            cut = n if last else int(at[-1])
            held, before = (None, 0) if last else (t.slice(cut), int(start[-1]))
            if cut:
                first = False
                run = np.cumsum(new_run)[:cut] - 1
                cols = [pa.array(np.full(cut, part, np.int32)), pa.array(start[run]), pa.array(size[run]), pa.array(edge[run])]
                yield from pa.Table.from_arrays([*(t.column(c).slice(0, cut) for c in names), *cols], names=[*names, "part", "start", "same", "edge"]).combine_chunks().to_batches(max_chunksize=20_000)

        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                yield from flush((t if held is None else pa.concat_tables([held, t])).combine_chunks(), False)
        if held is not None:
            yield from flush(held.combine_chunks(), True)

    types = dict(long.dtypes)
    local = stored(ranged.mapInArrow(count, ", ".join(f"{c} {types[c]}" for c in names) + ", part int, start long, same long, edge boolean"))
    # rows per range and key: at most the number of ranges plus the number of keys, as ranges follow the order
    totals = local.groupBy(*by, "part").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*by)
    offsets = totals.withColumn("offset", F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).withColumn("total", F.sum("n").over(whole)).drop("n")
    offsets = stored(offsets)
    # at most two values of each range
    edges = local.where("edge").select(*keys, "part", "start", "same").distinct().join(F.broadcast(offsets), [*by, "part"])
    edges = edges.groupBy(*keys).agg(F.min(F.col("start") + F.col("offset")).alias("e_start"), F.sum("same").alias("e_same"))
    out = local.join(F.broadcast(offsets), [*by, "part"]).join(F.broadcast(edges), keys, "left")
    start = F.when(F.col("edge"), F.col("e_start")).otherwise(F.col("start") + F.col("offset"))
    same = F.when(F.col("edge"), F.col("e_same")).otherwise(F.col("same"))
    return out.select(*names, ((start + same) / F.col("total")).alias("at_most"), ((F.col("total") - start) / F.col("total")).alias("at_least"))


def outlier_scores(stats: DataFrame) -> DataFrame:
    """The statistics with low_<statistic> and high_<statistic>, minus the logarithms of both tails, and outlier, the mean of the smaller tails'."""
    packed = F.explode(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(s).alias("value")) for n, s in enumerate(STATISTICS)])).alias("p")
    long = stats.select("row", "doc_id", "language", packed).select("row", "doc_id", "language", "p.stat", "p.value")
    tails = exact_tails(long, ["stat", "language"], "value", "row")
    low, high = -F.ln("at_most"), -F.ln("at_least")
    pick = lambda x, n: F.max(F.when(F.col("stat") == n, x))
    each = [pick(x, n).alias(f"{name}{s}") for n, s in enumerate(STATISTICS) for name, x in (("", F.col("value")), ("low_", low), ("high_", high))]
    return tails.groupBy("row", "doc_id", "language").agg(*each, F.avg(F.greatest(low, high)).alias("outlier"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (the first for the constant) of a logistic regression, by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def quality_scores(docs: DataFrame, labels: DataFrame, common: DataFrame, *, most: int = MOST_LABELLED, without: Sequence[str] = ()) -> DataFrame:
    """(doc_id, language, statistics..., tails..., outlier, not_prose): not_prose is the probability that a text is no prose.

    At most ``most`` labelled documents, by the hash of their ids, teach the pairs of prose (one half) and the weights
    of the tails (the other half); every statistic, rank and score covers all documents with text. With fewer than 20
    labels, or labels of one kind only, all tails weigh the same: not_prose is 1 - exp(1 - outlier), at least 0.
    ``without`` names statistics whose tails take no part in the verdict (to measure what they give).
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    sample = labelled_sample(labels, most)
    part = lambda k: spark.createDataFrame([x[:2] for x in sample if x[2] == k], f"doc_id {kind}, junk double")
    stats = stored(document_statistics(docs, common, prose_pairs(docs, part(0))))
    full = outlier_scores(stats)
    used = [s for s in STATISTICS if s not in without]
    weighed = ["outlier", *(f"{x}_{s}" for s in used for x in ("low", "high"))]
    taught = [x for x in sample if x[2] == 1]
    if len(sample) < 20 or len({junk > 0.5 for _, junk, _ in taught}) < 2:
        return full.withColumn("not_prose", F.greatest(F.lit(0.0), 1 - F.exp(1 - F.col("outlier")))).drop("row")
    full = stored(full)
    rows = full.join(F.broadcast(part(1)), "doc_id").select("doc_id", "junk", *weighed).dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    w = logistic(rows[weighed].to_numpy(float), rows["junk"].to_numpy(float))
    line = F.lit(float(w[0]))
    for c, v in zip(weighed, w[1:]):
        line = line + F.lit(float(v)) * F.col(c)
    return full.withColumn("not_prose", 1 / (1 + F.exp(-line))).drop("row")
