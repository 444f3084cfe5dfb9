"""One schema over files whose columns are added, renamed, removed or change type, and a list of every change.

Every file's header and cells are inferred on their own (a field's type is the tagged union of the kinds found in
its files), neighbouring files of a sensor are matched field by field, and each field keeps one typed branch per
kind plus a canonical conversion. Files meet their predecessor through an equi-join on (sensor, seq - 1), so a
sensor with very many files is no group of its own. Joins of tables that grow with the files are merge joins by hint:
their columns compress so well that the sizes by which Spark decides to broadcast say little about memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.operators.fieldnames import Fields
from flowquarry.operators.linetable import FIT, parse_lines
from flowquarry.operators.orderstats import exact_quantiles
from flowquarry.session import stored


def dictionary(column_dict: DataFrame) -> dict[str, dict]:
    """The dictionary of known fields as a Python mapping; it describes fields, not rows, and is of fixed size."""
    return {r["column_name"]: r.asDict() for r in column_dict.where("column_name is not null").collect()}


def file_columns(stats: DataFrame, patterns: int = 1) -> DataFrame:
    """One row per file and column: the chunks' counts added up, and the kind its cells show (null without such cells).

    m2 is the sum of squared distances from the chunks' own means; whole_columns adds the distances of these means.
    """
    sums = ["lines", "missing", "infinite", "whole", "decimals", "timestamps", "texts", "pos_inf", "total", "m2", "zeros", "negatives", "ln_total", "ln_squares"]
    fitted = [F.coalesce(F.sum(F.get("fitting", F.lit(i))), F.lit(0)) for i in range(patterns)]
    per = stats.groupBy("file_no", "position", "name").agg(
        F.max("chunks").alias("chunks"), *[F.sum(c).alias(c) for c in sums], F.min("least").alias("least"), F.max("most").alias("most"), F.max("median").alias("median"), F.array(*fitted).cast("array<long>").alias("fitted")
    )
    proper = F.col("whole") + F.col("decimals") + F.col("timestamps") + F.col("texts")
    kind = (
        F.when(proper == 0, None)
        .when(F.col("whole") >= FIT * proper, "whole")
        .when(F.col("whole") + F.col("decimals") >= FIT * proper, "decimal")
        .when(F.col("timestamps") >= FIT * proper, "timestamp")
        .otherwise("text")
    )
    return per.withColumn("finite", F.col("whole") + F.col("decimals")).withColumn("observed", kind).withColumn("fits", F.coalesce(F.array_max("fitted"), F.lit(0)))


def whole_columns(columns: DataFrame, stats: DataFrame) -> DataFrame:
    """Medians and spreads of files of more than one chunk, from all of their values; others have theirs from their chunk."""
    cut = stats.where("chunks > 1")
    if cut.isEmpty():
        return columns
    exact = exact_quantiles(cut.select("file_no", "position", F.explode("values").alias("v")), ["file_no", "position"], "v", [0.5]).select("file_no", "position", F.col("quantile").alias("exact"))
    means = columns.where("chunks > 1 and finite > 0").select("file_no", "position", (F.col("total") / F.col("finite")).alias("mean"))
    n = F.col("whole") + F.col("decimals")
    apart = cut.where(n > 0).join(means.hint("merge"), ["file_no", "position"]).groupBy("file_no", "position").agg(F.sum(n * F.pow(F.col("total") / n - F.col("mean"), F.lit(2.0))).alias("apart"))
    out = columns.join(exact.hint("merge"), ["file_no", "position"], "left").join(apart.hint("merge"), ["file_no", "position"], "left")
    return out.withColumn("median", F.when(F.col("chunks") > 1, F.col("exact")).otherwise(F.col("median"))).withColumn("m2", F.col("m2") + F.coalesce("apart", F.lit(0.0))).drop("exact", "apart")


def match_names(before: Sequence[str], now: Sequence[str], fields: Fields) -> dict[str, str]:
    """New name -> old name of the same field, for the names of two headers."""
    same = {x: x for x in now if x in set(before)}
    gone = [x for x in before if x not in same]
    fresh = [x for x in now if x not in same]
    options = []
    for a in fresh:
        fa, sa = fields.of(a)
        for b in gone:
            fb, sb = fields.of(b)
            if fa == fb:
                options.append((-(sa + sb), fresh.index(a), gone.index(b), a, b))
    used: set[str] = set()
    for _, _, _, a, b in sorted(options):
        if a not in same and b not in used:
            same[a] = b
            used.add(b)
    return same


def value_likeness(a: str, b: str) -> Column:
    """0 to 1: how alike the values of two columns are, by kind, spread of logarithms, shares of zeros and negatives, pattern.

    a and b prefix the columns of file_columns. Kinds that one number column may show as whole and another as decimal
    don't part them; columns without cells that show a kind are like nothing.
    """
    c = lambda p, n: F.col(f"{p}{n}")
    share = lambda p, n: F.coalesce(F.try_divide(c(p, n), c(p, "finite")), F.lit(0.0))
    solid = lambda p: c(p, "finite") - c(p, "zeros")
    mean = lambda p: F.coalesce(F.try_divide(c(p, "ln_total"), solid(p)), F.lit(0.0))
    spread = lambda p: F.sqrt(F.greatest(F.lit(0.0), F.coalesce(F.try_divide(c(p, "ln_squares"), solid(p)), F.lit(0.0)) - mean(p) * mean(p)))
    number = F.exp(-F.abs(mean(a) - mean(b)) / (0.5 + (spread(a) + spread(b)) / 2)) * (1 - F.abs(share(a, "zeros") - share(b, "zeros"))) * (1 - F.abs(share(a, "negatives") - share(b, "negatives")))
    fit = lambda p: F.coalesce(F.try_divide(c(p, "fits"), c(p, "texts")), F.lit(0.0))
    is_number = lambda p: c(p, "observed").isin("whole", "decimal")
    return F.coalesce(
        F.when(is_number(a) & is_number(b), number).when(c(a, "observed") != c(b, "observed"), 0.0).when(c(a, "observed") == "timestamp", 1.0).otherwise(F.when(c(a, "observed") == "text", 1 - F.abs(fit(a) - fit(b)))),
        F.lit(0.0),
    )


LINK_SCHEMA = "file_no long, prev_file_no long, name string, prev_name string, field string, listed boolean"


def file_pairs(columns: DataFrame, reports: DataFrame) -> DataFrame:
    """(file_no, names, prev_file_no, before): each file's header with the one of the sensor's previous file.

    Reports that came twice count once, by file_no; files without report have no previous one; of several files at one
    place of a sensor the lowest number is the previous one.
    """
    headers = columns.groupBy("file_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"]).alias("names"))
    place = reports.where("file_no is not null").groupBy("file_no").agg(F.max("sensor").alias("sensor"), F.max("seq").alias("seq"))
    files = headers.join(place.hint("merge"), "file_no", "left")
    before = files.where("sensor is not null and seq is not null").groupBy("sensor", (F.col("seq") + 1).alias("seq")).agg(F.min_by(F.struct(F.col("file_no").alias("prev_file_no"), F.col("names").alias("before")), "file_no").alias("p")).select("sensor", "seq", "p.*")
    return files.join(before.hint("merge"), ["sensor", "seq"], "left").select("file_no", "names", "prev_file_no", "before")


def found_names(columns: DataFrame, pairs: DataFrame, fields: Fields) -> dict[str, str]:
    """The field of each name that the dictionary does not list, by the evidence of all files.

    What is collected are counts by name and by pair of names: it grows with the number of different names, not with files.
    """
    names = [r[0] for r in columns.select("name").distinct().collect()]
    open_ = sorted(n for n in names if fields.listed(n) is None)
    if not open_:
        return {}
    unknown = F.array(*[F.lit(n) for n in open_])
    come, go = F.array_except("names", "before"), F.array_except("before", "names")
    moved = pairs.where("before is not null").select("file_no", "prev_file_no", come.alias("come"), go.alias("go")).where("size(come) > 0 and size(go) > 0")
    ways = moved.select("file_no", "prev_file_no", F.array(F.struct(F.array_intersect("come", unknown).alias("u"), F.col("go").alias("x"), F.lit(True).alias("came")), F.struct(F.array_intersect("go", unknown).alias("u"), F.col("come").alias("x"), F.lit(False).alias("came"))).alias("ways"))
    each = ways.select("file_no", "prev_file_no", F.explode("ways").alias("w")).select("file_no", "prev_file_no", F.explode("w.u").alias("u"), "w.x", "w.came")
    changes = {r["u"]: r["n"] for r in each.groupBy("u").agg(F.count("*").alias("n")).collect()}
    swap = each.select("u", F.explode("x").alias("x"), F.when(F.col("came"), F.col("file_no")).otherwise(F.col("prev_file_no")).alias("fu"), F.when(F.col("came"), F.col("prev_file_no")).otherwise(F.col("file_no")).alias("fx"))
    side = lambda p, f, n: columns.select(*[F.col(c).alias({"file_no": f, "name": n}.get(c, p + c)) for c in ("file_no", "name", "observed", "finite", "zeros", "negatives", "ln_total", "ln_squares", "fits", "texts")])
    valued = swap.join(side("a_", "fu", "u").hint("merge"), ["fu", "u"]).join(side("b_", "fx", "x").hint("merge"), ["fx", "x"])
    swaps = {(r["u"], r["x"]): (r["n"], r["v"]) for r in valued.groupBy("u", "x").agg(F.count("*").alias("n"), F.avg(value_likeness("a_", "b_")).alias("v")).collect()}
    here = pairs.select("names", F.array_intersect("names", unknown).alias("u")).where("size(u) > 0").select("names", F.explode("u").alias("u")).select("u", F.explode("names").alias("x")).where("u <> x")
    together = {(r["u"], r["x"]) for r in here.distinct().collect()}
    totals = columns.groupBy("name").agg(F.mode("observed").alias("observed"), *[F.sum(c).alias(c) for c in ("finite", "zeros", "negatives", "ln_total", "ln_squares", "fits", "texts")])
    pick = lambda p, which: totals.where(which).select(*[F.col(c).alias(p + c) for c in totals.columns])
    # names by names
    alike = {(r["u"], r["x"]): r["v"] for r in pick("a_", F.col("name").isin(open_)).crossJoin(pick("b_", F.lit(True))).select(F.col("a_name").alias("u"), F.col("b_name").alias("x"), value_likeness("a_", "b_").alias("v")).collect()}
    return fields.resolve(names, swaps, changes, together, alike)


def link_columns(pairs: DataFrame, known: Mapping[str, Sequence[str]], found: Mapping[str, str]) -> DataFrame:
    """Rows (file_no, prev_file_no, name, prev_name, field, listed): each column with its like in the sensor's previous file.

    A removed column has a null name, an added one a null prev_name; both file numbers are set whenever the sensor
    has a previous file.
    """

    def link(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = Fields(known, found)
        for frame in frames:
            out = []
            for no, names, prev, old in zip(frame.file_no, frame.names, frame.prev_file_no, frame.before):
                names = list(names)
                has = old is not None
                old = list(old) if has else []
                same = match_names(old, names, fields)
                best: dict[str, tuple[float, int]] = {}
                for n, name in enumerate(names):
                    f, sure = fields.of(name)
                    if f not in best or sure > best[f][0]:
                        best[f] = (sure, n)
                for n, name in enumerate(names):
                    f, sure = fields.of(name)
                    owner = best[f][1] == n
                    out.append((no, prev if has else None, name, same.get(name), f if owner else name, owner and f in known))
                out += [(no, prev, None, x, None, None) for x in old if x not in set(same.values())]
            yield pd.DataFrame(out, columns=["file_no", "prev_file_no", "name", "prev_name", "field", "listed"]).astype({"file_no": "Int64", "prev_file_no": "Int64", "listed": "boolean"})

    return pairs.mapInPandas(link, LINK_SCHEMA)


def resolve_kinds(columns: DataFrame, links: DataFrame) -> DataFrame:
    """(file_no, name, kind): the kind shown by the cells, else the one that the column had in the file before.

    Columns without a cell that could show a kind look back as far as their field goes; pointers double each round.
    Without any such cell in all files before, the kind is null.
    """
    out = columns.where("observed is not null").select("file_no", "name", F.col("observed").alias("kind"))
    blank = columns.where("observed is null").select("file_no", "name")
    open_ = blank.join(links.where("name is not null and prev_name is not null").hint("merge"), ["file_no", "name"]).select("file_no", "name", F.col("prev_file_no").alias("p"), F.col("prev_name").alias("pn"))
    while True:
        open_ = stored(open_)
        at = out.select(F.col("file_no").alias("p"), F.col("name").alias("pn"), "kind")
        out = out.unionByName(stored(open_.join(at.hint("merge"), ["p", "pn"]).select("file_no", "name", "kind")))
        hop = open_.select(F.col("file_no").alias("p"), F.col("name").alias("pn"), F.col("p").alias("p2"), F.col("pn").alias("pn2"))
        open_ = open_.join(hop.hint("merge"), ["p", "pn"]).select("file_no", "name", F.col("p2").alias("p"), F.col("pn2").alias("pn"))
        if open_.isEmpty():
            break
    return columns.select("file_no", "name").join(out.hint("merge"), ["file_no", "name"], "left")


def parse_states(raw: DataFrame, column_dict: DataFrame, labels: Sequence[str] | None = None, *, lines: bool = True, cells: bool = False, hashes: bool = False, path: str | None = None) -> DataFrame:
    """The states of files: parse_lines with the dictionary's patterns, stored (under path, if given, beside what is there).

    States of different files add up: they can be stored load by load, and Files takes the union of any of them. A file
    belongs to one load.
    """
    patterns = [d["pattern"] for d in dictionary(column_dict).values() if d.get("pattern")]
    parsed = parse_lines(raw, labels=labels, patterns=patterns, lines=lines, cells=cells, hashes=hashes)
    if path is None:
        return stored(parsed)
    parsed.write.mode("append").parquet(path)
    return raw.sparkSession.read.schema(parsed.schema).parquet(path)


class Files:
    """Parsed files: lines, columns with kinds, and each column's like in the file before."""

    def __init__(self, raw: DataFrame | None, reports: DataFrame, column_dict: DataFrame, labels: Sequence[str] | None = None, *, states: DataFrame | None = None, **how: bool):
        self.known = dictionary(column_dict)
        self.patterned = [f for f, d in self.known.items() if d.get("pattern")]
        self.raw, self.column_dict = raw, column_dict
        parsed = parse_states(raw, column_dict, labels, **how) if states is None else states
        self.lines = parsed.where("line is not null").select("line.*")
        self.stats = parsed.where("stat is not null").select("stat.*")
        columns = stored(whole_columns(file_columns(self.stats, len(self.patterned)), self.stats))
        names = {f: d.get("aliases") or [] for f, d in self.known.items()}
        pairs = stored(file_pairs(columns, reports))
        self.found = found_names(columns, pairs, Fields(names))
        self.links = stored(link_columns(pairs, names, self.found))
        kinds = resolve_kinds(columns, self.links)
        self.columns = columns.join(kinds.hint("merge"), ["file_no", "name"], "left")


def schema_changes(files: Files) -> DataFrame:
    """(file_no, change, column_name): added, removed, renamed and retyped columns against the sensor's previous file."""
    links = files.links.where("prev_file_no is not null")
    kinds = files.columns.select("file_no", "name", "kind")
    now = links.join(kinds.hint("merge"), ["file_no", "name"], "left")
    old = kinds.select(F.col("file_no").alias("prev_file_no"), F.col("name").alias("prev_name"), F.col("kind").alias("prev_kind"))
    both = now.join(old.hint("merge"), ["prev_file_no", "prev_name"], "left")
    change = F.array_compact(
        F.array(
            F.when(F.col("prev_name").isNull(), "added"),
            F.when(F.col("name").isNull(), "removed"),
            F.when(F.col("name") != F.col("prev_name"), "renamed"),
            F.when(F.col("kind") != F.col("prev_kind"), "retyped"),
        )
    )
    return both.select("file_no", F.explode(change).alias("change"), F.coalesce("name", "prev_name").alias("column_name"))


def unified_schema(files: Files) -> DataFrame:
    """The fused schema: one row per field with its canonical kind, and each alternative kind with the files that have it.

    canonical is the widest kind that all alternatives convert to: whole, decimal (whole and decimal), timestamp,
    else text.
    """
    typed = files.columns.join(files.links.where("name is not null").select("file_no", "name", "field").hint("merge"), ["file_no", "name"])
    per = typed.groupBy("field", "kind").agg(F.count("*").alias("files"), F.min("file_no").alias("first_file"), F.array_sort(F.collect_set("name")).alias("names"))
    kinds = F.collect_set("kind")
    canonical = (
        F.when(F.size(kinds) == 0, None)
        .when(F.size(F.array_except(kinds, F.array(F.lit("whole")))) == 0, "whole")
        .when(F.size(F.array_except(kinds, F.array(F.lit("whole"), F.lit("decimal")))) == 0, "decimal")
        .when(F.size(F.array_except(kinds, F.array(F.lit("timestamp")))) == 0, "timestamp")
        .otherwise("text")
    )
    return per.groupBy("field").agg(canonical.alias("canonical"), F.array_sort(F.collect_list(F.struct("kind", "files", "first_file", "names"))).alias("alternatives"))


#: Spark types of the branches.
BRANCH = {"whole": "bigint", "decimal": "double", "timestamp": "timestamp", "text": "string"}
# Spellings of infinite and missing cells, and of numbers.
_INFINITE, _MISSING, _NUMBER = r"(?i)^[+-]?inf(inity)?$", r"(?i)^(nan|na|null)?$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def converted(cell: Column, kind: str) -> Column:
    """A cell as a value of the kind, or null."""
    if kind == "whole":
        return F.when(cell.rlike(r"^[+-]?\d+$"), cell.try_cast("bigint"))
    if kind == "decimal":
        return F.when(cell.rlike(_INFINITE), F.when(cell.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).when(cell.rlike(_NUMBER), cell.try_cast("double"))
    return F.try_to_timestamp(cell, F.lit("yyyy-MM-dd HH:mm:ss")) if kind == "timestamp" else cell


def unified_rows(files: Files) -> DataFrame:
    """All loadable lines of all files in one table, with columns for each known field after the inferred union of its kinds.

    The field's own column has its canonical kind (double for whole and decimal); where files differ in kind, each kind has
    a branch ``<field>:<kind>`` beside it, which holds the cells of the files of that kind. Cells that don't convert to the
    canonical kind, and all cells of other fields, stand in the map ``as_text``; missing cells are null everywhere.
    A known field that no file shows with a value has a text column.
    """
    # one row per field
    union = {r["field"]: (r["canonical"], [a["kind"] for a in r["alternatives"] if a["kind"]]) for r in unified_schema(files).where(F.col("field").isin(list(files.known))).collect()}
    fields = files.links.where("name is not null").join(files.columns.select("file_no", "name", "position", "kind").hint("merge"), ["file_no", "name"])
    heads = fields.groupBy("file_no").agg(F.array_sort(F.collect_list(F.struct("position", "field", "kind"))).alias("h"))
    rows = files.lines.where("reason is null and cells is not null").join(heads.hint("merge"), "file_no")
    given = F.map_filter(F.map_from_arrays(F.transform("h", lambda x: x["field"]), "cells"), lambda k, v: ~v.rlike(_MISSING))
    rows = rows.select("file_no", "line_no", given.alias("m"), F.map_from_arrays(F.transform("h", lambda x: x["field"]), F.transform("h", lambda x: F.coalesce(x["kind"], F.lit("text")))).alias("kinds"))
    out, fitted = [], []
    for f in files.known:
        canonical, kinds = union.get(f, ("text", []))
        cell = F.col("m")[f]
        typed = converted(cell, "decimal" if canonical == "whole" else canonical or "text")
        out.append(typed.alias(f))
        fitted.append(F.when(typed.isNotNull(), F.lit(f)))
        if len(kinds) > 1:
            out += [F.when(F.col("kinds")[f] == k, converted(cell, k)).alias(f"{f}:{k}") for k in sorted(kinds)]
    fit = F.array_compact(F.array(*fitted))
    return rows.select("file_no", "line_no", *out, F.map_filter("m", lambda k, v: ~F.array_contains(fit, k)).alias("as_text"))
