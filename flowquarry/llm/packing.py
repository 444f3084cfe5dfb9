"""Filling containers of fixed capacity with documents, by sum-of-squares packing.

Each document goes where the sum, over all gaps, of the squared number of open containers with that gap becomes
smallest. An open container's gap is all that the rule needs, so a task keeps one counter and one list of containers
per gap. Documents of a group are dealt by hash to chunks that are packed independently, so that any group, whatever its
size, is spread over tasks. What a chunk leaves loosely filled is taken out again, dealt together with that of the other
chunks and packed once more, round by round, until one chunk holds what is left of a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.tokens import plain_key, token_count
from flowquarry.session import stored

#: Documents that one task packs together.
CHUNK = 25_000
#: Share of the capacity that a container of one chunk of several may leave unused; others are packed again.
LOOSE = 0.005


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item (sizes from 1 to capacity), in the order of arrival; ties go to the tightest open one."""
    open_ = np.zeros(capacity + 1, np.int64)  # open containers by gap, gaps 1 to capacity - 1
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    where = np.empty(len(sizes), np.int64)
    used = 0
    for i, s in enumerate(sizes.tolist()):
        best, gap = (2 * int(open_[capacity - s]) + 1 if s < capacity else 0), 0
        if s < capacity:
            here = open_[s:capacity]
            change = 2 * (open_[: capacity - s] - here) + 2
            change[0] = 1 - 2 * int(here[0])  # filled up: it is no open container any more
            change[here == 0] = np.iinfo(np.int64).max
            j = int(change.argmin())
            if change[j] <= best:
                gap = s + j
        if gap:
            box = stacks[gap].pop()
            open_[gap] -= 1
        else:
            box, gap = used, capacity
            used += 1
        where[i] = box
        if gap > s:
            stacks[gap - s].append(box)
            open_[gap - s] += 1
    return where


def pack_documents(docs: DataFrame, containers: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", other: str = "und", chunk: int = CHUNK, loose: float = LOOSE) -> DataFrame:
    """(lang, capacity, container, doc_id, piece, pieces, tokens): each document, or each piece of one over the capacity.

    Language: trimmed, lower case; the row ``other`` if null or not listed. A document over the capacity is cut into
    full pieces, which fill containers of their own, and a rest that is packed as an item. Documents without tokens
    take no room: piece 0 of 0, no container. Repeated ids are packed as rows of their own.
    """
    # one row per language
    caps = {r["lang"]: r["capacity"] for r in containers.where("lang is not null and capacity > 0").groupBy(plain_key(F.col("lang")).alias("lang")).agg(F.max("capacity").cast("int").alias("capacity")).collect()}
    if other not in caps:
        raise ValueError(f"no container for the language {other}")
    table = F.create_map(*[F.lit(x) for kv in sorted(caps.items()) for x in kv])
    sized = docs.select(F.col(f"`{id_col}`").alias("doc_id"), plain_key(F.col(f"`{lang_col}`")).alias("l"), token_count(F.col(f"`{text_col}`")).alias("tokens"))
    sized = sized.withColumn("lang", F.when(F.element_at(table, F.col("l")).isNotNull(), F.col("l")).otherwise(F.lit(other)))
    sized = stored(sized.select(F.monotonically_increasing_id().alias("row"), "doc_id", "lang", F.element_at(table, F.col("lang")).alias("capacity"), "tokens"))
    full, rest = F.floor(F.col("tokens") / F.col("capacity")), F.col("tokens") % F.col("capacity")
    pieces = F.ceil(F.col("tokens") / F.col("capacity")).alias("pieces")
    zero = F.lit(0).cast("long")
    none = sized.where("tokens = 0").select("lang", "capacity", F.lit(None).cast("string").alias("container"), "doc_id", zero.alias("piece"), zero.alias("pieces"), zero.alias("tokens"))
    whole = sized.where(full > 0).select("lang", "capacity", "row", "doc_id", pieces, F.explode(F.sequence(F.lit(1).cast("long"), full)).alias("piece"))
    whole = whole.select("lang", "capacity", F.concat_ws("-", "lang", F.lit("full"), "row", "piece").alias("container"), "doc_id", "piece", "pieces", F.col("capacity").cast("long").alias("tokens"))
    items = sized.where(rest > 0).select("lang", "capacity", "row", "doc_id", pieces, rest.alias("tokens"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row", kind="stable")
        cap, lang, no, step = int(frame.capacity.iloc[0]), frame.lang.iloc[0], int(frame.chunk.iloc[0]), int(frame.step.iloc[0])
        boxes = sum_of_squares(frame.tokens.to_numpy(), cap)
        level = np.bincount(boxes, weights=frame.tokens.to_numpy())[boxes]
        return frame[["lang", "capacity", "row", "doc_id", "pieces", "tokens"]].assign(container=[f"{lang}-{step}-{no}-{b}" for b in boxes], loose=(int(frame.chunks.iloc[0]) > 1) & (cap - level > loose * cap))

    kind = dict(sized.dtypes)["doc_id"]
    done, step, before = [], 0, None
    while True:
        sizes = {r["lang"]: r["n"] for r in items.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
        if not sizes:
            break
        again = before is None or sum(sizes.values()) < 0.9 * before  # else another round would gain little
        chunks = {k: max(1, -(-n // chunk)) for k, n in sizes.items()}
        deal = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(chunks.items()) for x in kv]), F.col("lang"))
        dealt = items.withColumn("chunk", F.pmod(F.xxhash64(F.lit(11 + step), "row", "doc_id"), deal).cast("int")).withColumn("chunks", deal if again else F.lit(1)).withColumn("step", F.lit(step))
        packed = stored(dealt.groupBy("lang", "chunk").applyInPandas(pack, f"lang string, capacity int, row long, doc_id {kind}, pieces long, tokens long, container string, loose boolean"))
        done.append(packed.where("not loose").select("lang", "capacity", "container", "doc_id", F.col("pieces").alias("piece"), "pieces", "tokens"))
        items = packed.where("loose").select("lang", "capacity", "row", "doc_id", "pieces", "tokens")
        step, before = step + 1, sum(sizes.values())
    out = none.unionByName(whole)
    for d in done:
        out = out.unionByName(d)
    return out


def packing_report(packed: DataFrame) -> DataFrame:
    """Per language: containers used, the least number that could do, and the share of unused space."""
    boxes = packed.where("container is not null")
    per = boxes.groupBy("lang").agg(F.max("capacity").alias("capacity"), F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"), F.count_distinct("doc_id").alias("documents"))
    return per.select("*", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused"))
