"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected equally often: copies per document = wanted tokens / tokens of the source, at
most the cap on repeats. Documents of a source stand in the order of their size, expected copies are summed up along
that order after one random offset, and a document is taken once for each integer boundary its sum crosses; so the
copies spread evenly over sizes and their tokens stay near the target. Positions in a source come from counts of
(size, block) and ranks within a block, never from one sort of a whole source. As the copies are the same for all
documents of a source, the position of every boundary is known beforehand, and only chosen documents are joined.
Texts are read once, for their sizes. Whether a source falls short is read off the selection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.llm.tokens import plain_key, token_count

#: Documents of one source and size that are ranked together.
BLOCK = 50_000
#: Chosen documents that one row is expanded to at once.
RUN = 10_000


def sized_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(source, doc_id, tokens) of the documents with a source and at least one token; sources trimmed and in lower case.

    Repeated ids count by their rows. The result takes the place of the texts: store it once and use it for all mixes.
    """
    return docs.select(plain_key(F.col(f"`{source_col}`")).alias("source"), F.col(f"`{id_col}`").alias("doc_id"), token_count(F.col(f"`{text_col}`")).alias("tokens")).where("source is not null and tokens > 0")


def placed_documents(sized: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(source, doc_id, tokens, place): the place of each document within its source, from 1, by size."""
    counts = sized.groupBy("source", "tokens").agg(F.count("*").alias("n"))
    blocks = counts.select("source", "tokens", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    keyed = sized.join(blocks, ["source", "tokens"]).withColumn("block", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.col("blocks")).cast("int")).drop("blocks")
    per = keyed.groupBy("source", "tokens", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("tokens", "block").rowsBetween(Window.unboundedPreceding, -1)
    start = per.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("source", "tokens", "block").orderBy("doc_id"))
    return keyed.withColumn("r", rank).join(start, ["source", "tokens", "block"]).select("source", "doc_id", "tokens", (F.col("start") + F.col("r")).alias("place"))


def mix_rates(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per row of targets: the source's documents and tokens, and the copies of each of its documents that are expected.

    copies = wanted tokens (target_share * total_tokens) / tokens of the source, at most max_repeats. Null shares,
    sizes and caps count as zero.
    """
    totals = sized.groupBy(F.col("source").alias("key")).agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("documents"))
    want = targets.select("mix_no", "source", "target_share", "max_repeats", "total_tokens", plain_key(F.col("source")).alias("key"), (F.coalesce("target_share", F.lit(0.0)) * F.coalesce("total_tokens", F.lit(0))).alias("wanted"))
    joined = want.join(totals, "key", "left").withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0))).withColumn("documents", F.coalesce("documents", F.lit(0)))
    return joined.withColumn("copies", F.coalesce(F.least(F.coalesce("max_repeats", F.lit(0)).cast("double"), F.try_divide(F.col("wanted"), F.col("source_tokens"))), F.lit(0.0)))


def mixed_documents(sized: DataFrame, rates: DataFrame, *, seed: int = 3) -> DataFrame:
    """(mix_no, source, doc_id, tokens, copies): the selection, by systematic sampling with the rates of mix_rates."""
    placed = placed_documents(sized)
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix_no", "key"), 11).cast("double") / F.lit(float(1 << 53))
    rows = rates.where("copies > 0 and documents > 0").select("mix_no", "key", "copies", "documents", u.alias("u")).withColumn("boundaries", F.floor(F.col("documents") * F.col("copies") + F.col("u")).cast("long"))
    runs = rows.where("boundaries > 0").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("boundaries") - 1) / RUN))))
    k = F.explode(F.sequence(F.col("run") * RUN + 1, F.least(F.col("boundaries"), (F.col("run") + 1) * RUN))).alias("k")
    place = F.least("documents", F.greatest(F.lit(1).cast("long"), F.ceil((F.col("k") - F.col("u")) / F.col("copies")).cast("long")))
    taken = runs.select("*", k).select("mix_no", F.col("key").alias("source"), place.alias("place")).groupBy("mix_no", "source", "place").agg(F.count("*").alias("copies"))
    return taken.join(placed, ["source", "place"]).select("mix_no", "source", "doc_id", "tokens", "copies")


def mix_report(rates: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rates with tokens reached, their share of the mix, the copies used, and whether the source falls short.

    short: the selection holds every document of the source as often as the cap allows (or there is nothing to take)
    and its tokens are still fewer than wanted. A selection that isn't exhausted misses its target by sampling only.
    """
    got = chosen.groupBy("mix_no", F.col("source").alias("key")).agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens_reached"), F.max("copies").alias("most_copies"), F.min("copies").alias("least_copies"), F.count("*").alias("documents_used")
    )
    total = got.groupBy("mix_no").agg(F.sum("tokens_reached").alias("mix_tokens"))
    out = rates.join(got, ["mix_no", "key"], "left").join(total, "mix_no", "left")
    reached, used = F.coalesce("tokens_reached", F.lit(0)), F.coalesce("documents_used", F.lit(0))
    exhausted = (used == F.col("documents")) & (F.coalesce("least_copies", F.lit(0)) >= F.coalesce("max_repeats", F.lit(0)))
    nothing = (F.col("documents") == 0) | (F.coalesce("max_repeats", F.lit(0)) <= 0)
    return out.select(
        "mix_no", "source", "target_share", "max_repeats", "total_tokens", "source_tokens", "documents", "copies", "wanted", ((exhausted | nothing) & (reached < F.col("wanted"))).alias("short"),
        reached.alias("tokens_reached"), F.try_divide(reached, F.col("mix_tokens")).alias("share_reached"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), used.alias("documents_used"),
    )
