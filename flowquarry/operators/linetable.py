"""Loading of delimited text that is kept line by line: rejected lines with their reason, typed profiles of the rest.

The text of many files is parsed together on Arrow batches. Lines of the same number of columns go through one
call of the pyarrow CSV reader, whose callback for invalid rows gives the lines with a wrong number of cells; all
fields are read as strings, and vectors of cells are then classified and cast. A file is cut into chunks of lines,
which any task can take, so that a file that holds a large part of all lines is no single task; every chunk gets
the file's header line.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of one file that a task parses together.
CHUNK = 20_000
#: Rows that are parsed in one go.
BLOCK = 60_000

MISSING, INFINITE, WHOLE, DECIMAL, TIMESTAMP, TEXT = range(6)
KINDS = {WHOLE: "whole", DECIMAL: "decimal", TIMESTAMP: "timestamp", TEXT: "text"}
FIT = 0.8

_GOOD_QUOTES = r'^(?:[^",]*|"(?:[^"]|"")*")(?:,(?:[^",]*|"(?:[^"]|"")*"))*$'

LINE_SCHEMA = "file_no long, chunk int, line_no int, reason string, no_number array<long>, no_time array<long>, label_ok boolean, cells array<string>"
STAT_SCHEMA = (
    "file_no long, chunk int, chunks int, position int, name string, lines long, missing long, infinite long, whole long, decimals long, timestamps long, texts long, "
    "pos_inf long, least double, most double, total double, m2 double, zeros long, negatives long, median double, ln_total double, ln_squares double, fitting array<long>, values array<double>, distinct_hashes array<long>"
)
OUT_SCHEMA = f"line struct<{LINE_SCHEMA.replace(' array', ': array').replace(' long', ': long').replace(' int', ': int').replace(' string', ': string').replace(' boolean', ': boolean')}>, stat struct<{STAT_SCHEMA.replace(' array', ': array').replace(' long', ': long').replace(' int', ': int').replace(' string', ': string').replace(' double', ': double')}>"
KMV = 256


def unique_names(cells: Iterable[str]) -> list[str]:
    """Trimmed names; a repeated name gets .1, .2 and so on, or the next number that is free."""
    out: list[str] = []
    seen: set[str] = set()
    for cell in cells:
        base = name = cell.strip()
        n = 0
        while name in seen:
            n += 1
            name = f"{base}.{n}"
        seen.add(name)
        out.append(name)
    return out


def header_names(line: str) -> list[str]:
    """Names of a header line, parted by commas outside of quotes."""
    text = line.lstrip("\ufeff").rstrip("\r\n")
    return unique_names(next(csv.reader([text]), [""]) if '"' in text else text.split(","))


def normalized_labels(texts: pa.Array) -> pa.Array:
    """Trimmed, dash-like characters with the space around them as ' - ', white space collapsed, lower case."""
    t = pc.replace_substring_regex(texts, "[\\s ]*[–—�\u0096][\\s ]*", " - ")
    t = pc.replace_substring_regex(t, "[\\s ]+", " ")
    return pc.utf8_lower(pc.utf8_trim_whitespace(t))


def classify(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Class of each trimmed cell, and its number (NaN where it is none; infinite cells give infinities)."""
    n = len(cells)
    kind = np.full(n, TEXT, np.int8)
    value = np.full(n, np.nan)
    left = np.arange(n)
    rest = cells

    def take(mask: pa.Array, code: int) -> pa.Array:
        nonlocal left, rest
        m = mask.to_numpy(zero_copy_only=False)
        kind[left[m]] = code
        got = rest.filter(mask)
        at = left[m]
        left, rest = left[~m], rest.filter(pc.invert(mask))
        if code in (WHOLE, DECIMAL):
            value[at] = pc.cast(pc.replace_substring_regex(got, r"^\+", ""), pa.float64()).to_numpy()
        elif code == INFINITE:
            value[at] = np.where(pc.starts_with(got, "-").to_numpy(zero_copy_only=False), -np.inf, np.inf)
        return got

    take(pc.match_substring_regex(rest, r"^[+-]?[0-9]+$"), WHOLE)
    take(pc.match_substring_regex(rest, r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), DECIMAL)
    take(pc.match_substring_regex(rest, r"(?i)^(?:nan|na|null)?$"), MISSING)
    take(pc.match_substring_regex(rest, r"(?i)^[+-]?inf(?:inity)?$"), INFINITE)
    shaped = pc.match_substring_regex(rest, r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$")
    if pc.any(shaped).as_py():
        parts = pc.if_else(shaped, rest, "1970-01-01 00:00:00")
        number = lambda a, b: pc.cast(pc.utf8_slice_codeunits(parts, a, b), pa.int32()).to_numpy()
        y, mo, d, h, mi, s = number(0, 4), number(5, 7), number(8, 10), number(11, 13), number(14, 16), number(17, 19)
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        days = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(mo, 0, 12)] + (leap & (mo == 2))
        real = (y >= 1) & (mo >= 1) & (mo <= 12) & (d >= 1) & (d <= days) & (h < 24) & (mi < 60) & (s < 60)
        take(pc.and_(shaped, pa.array(real)), TIMESTAMP)
    return kind, value


def _words(bits: np.ndarray) -> pa.Array:
    """Rows of booleans as rows of 62-bit words."""
    n, w = bits.shape
    words = np.zeros((n, (w + 61) // 62), np.int64)
    for j in range(w):
        words[:, j // 62] |= bits[:, j].astype(np.int64) << (j % 62)
    flat = pa.array(words.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * words.shape[1]), flat)


def _parse(texts: pa.Array, at: np.ndarray, width: int) -> tuple[np.ndarray, list[pa.Array], list[int]]:
    """Rows (by at) with width cells and their columns; rows with another number of cells, from the reader's callback."""
    bad: list[int] = []

    def invalid(row: pacsv.InvalidRow) -> str:
        bad.append(int(row.text.split(",", 1)[0]))
        return "skip"

    lines = pc.binary_join_element_wise(pc.cast(pa.array(at), pa.string()), texts, ",")
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")[0].as_buffer()
    names = ["at", *(f"c{j}" for j in range(width))]
    got = pacsv.read_csv(
        pa.BufferReader(joined),
        read_options=pacsv.ReadOptions(use_threads=False, column_names=names, block_size=max(1 << 20, joined.size + 1)),
        parse_options=pacsv.ParseOptions(invalid_row_handler=invalid),
        convert_options=pacsv.ConvertOptions(column_types={"at": pa.int64()} | {c: pa.string() for c in names[1:]}, strings_can_be_null=False, check_utf8=False),
    ).combine_chunks()
    one = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return one(got.column("at")).to_numpy(), [one(got.column(c)) for c in names[1:]], bad


def chunked_lines(raw: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """Lines once each, by (file_no, chunk), with the file's header line in each of its chunks.

    Repeated lines (same file_no and line_no) count once; null text is an empty line; rows without file_no or
    line_no take no part.
    """
    lines = raw.select(F.col("file_no").cast("long"), F.col("line_no").cast("int"), F.coalesce("line_text", F.lit("")).alias("line_text")).where("file_no is not null and line_no is not null")
    last = lines.groupBy("file_no").agg(F.floor(F.max("line_no") / chunk).cast("int").alias("last"))
    body = lines.where("line_no <> 1").withColumn("chunk", F.floor(F.col("line_no") / chunk).cast("int")).withColumn("chunks", F.lit(None).cast("int"))
    head = lines.where("line_no = 1").join(last.hint("merge"), "file_no").withColumn("chunk", F.explode(F.sequence(F.lit(0), "last"))).select("file_no", "line_no", "line_text", "chunk", (F.col("last") + 1).alias("chunks"))
    return body.unionByName(head).repartition("file_no", "chunk").sortWithinPartitions("file_no", "chunk", "line_no")


def parse_lines(
    raw: DataFrame,
    *,
    labels: Sequence[str] | None = None,
    patterns: Sequence[str] = (),
    lines: bool = True,
    cells: bool = False,
    stats: bool = True,
    hashes: bool = False,
    chunk: int = CHUNK,
) -> DataFrame:
    """One pass over raw lines: rows with ``line`` (one per data line) or ``stat`` (one per file, chunk and column).

    line.reason is header, quoting, columns, blank or null; no_number and no_time are bit sets of cells that are no
    number (nor missing or infinite) and no time (nor missing). stat counts the classes of the cells of the lines
    without a reason. A file without line 1 has no columns and gives lines with reason columns. Line breaks inside
    of a line count as spaces.
    """
    known = None if labels is None else pa.array(sorted(set(labels)))
    line_type = pa.struct([("file_no", pa.int64()), ("chunk", pa.int32()), ("line_no", pa.int32()), ("reason", pa.string()), ("no_number", pa.list_(pa.int64())), ("no_time", pa.list_(pa.int64())), ("label_ok", pa.bool_()), ("cells", pa.list_(pa.string()))])
    ints, doubles = ["lines", "missing", "infinite", "whole", "decimals", "timestamps", "texts", "pos_inf", "zeros", "negatives"], ["least", "most", "total", "m2", "median", "ln_total", "ln_squares"]
    order = [x.strip().split(" ")[0] for x in STAT_SCHEMA.split(",")]
    kinds = {"file_no": pa.int64(), "chunk": pa.int32(), "chunks": pa.int32(), "position": pa.int32(), "name": pa.string(), "fitting": pa.list_(pa.int64()), "values": pa.list_(pa.float64()), "distinct_hashes": pa.list_(pa.int64())}
    kinds |= dict.fromkeys(ints, pa.int64()) | dict.fromkeys(doubles, pa.float64())
    stat_type = pa.struct([(c, kinds[c]) for c in order])

    def block(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        col = lambda c: t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c)
        file_no, chunk_no, line_no = (col(c).to_numpy(zero_copy_only=False) for c in ("file_no", "chunk", "line_no"))
        text = pc.replace_substring_regex(col("line_text"), "\r$", "")
        again = np.zeros(len(file_no), bool)
        again[1:] = (file_no[1:] == file_no[:-1]) & (chunk_no[1:] == chunk_no[:-1]) & (line_no[1:] == line_no[:-1])
        new = np.ones(len(file_no), bool)
        new[1:] = (file_no[1:] != file_no[:-1]) | (chunk_no[1:] != chunk_no[:-1])
        group = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        has_head = line_no[starts] == 1
        heads = [h.lstrip("﻿") if ok else None for h, ok in zip(text.take(pa.array(starts)).to_pylist(), has_head)]
        names = [header_names(h) if h is not None else [] for h in heads]
        widths = np.array([len(x) for x in names])
        label_at = np.array([next((i for i, x in enumerate(ns) if x.lower() == "label"), -1) for ns in names])
        n_chunks = col("chunks").fill_null(1).to_numpy(zero_copy_only=False)[starts]

        body = np.flatnonzero(~again & (line_no != 1))
        if len(body):
            text, g = text.take(pa.array(body)), group[body]
        else:
            text, g = text.slice(0, 0), group[:0]
        n = len(body)
        reason = np.full(n, None, object)
        plain = pc.replace_substring_regex(text, "[\r\n]", " ")
        blank = pc.equal(pc.utf8_length(pc.utf8_trim_whitespace(pc.replace_substring(plain, "﻿", ""))), 0).to_numpy(zero_copy_only=False)
        repeat = pc.fill_null(pc.equal(pc.replace_substring_regex(text, "^﻿", ""), pa.array(heads, pa.string()).take(pa.array(g))), False).to_numpy(zero_copy_only=False)
        quoted = pc.match_substring(plain, '"').to_numpy(zero_copy_only=False)
        at = np.flatnonzero(quoted)
        broken = np.zeros(n, bool)
        if len(at):
            broken[at] = ~pc.match_substring_regex(plain.take(pa.array(at)), _GOOD_QUOTES).to_numpy(zero_copy_only=False)
        reason[broken] = "quoting"
        reason[repeat] = "header"
        reason[blank] = "blank"
        open_ = np.equal(reason, None)
        ok_label = np.ones(n, bool)
        rows_of: list[np.ndarray] = []  # rows that the lists below belong to, in their order
        bits_of: tuple[list[pa.Array], list[pa.Array]] = ([], [])
        cells_of: list[pa.Array] = []
        pieces = []
        for w in np.unique(widths[g[open_]]) if open_.any() else []:
            mine = np.flatnonzero(open_ & (widths[g] == w))
            if w == 0:
                reason[mine] = "columns"
                continue
            got, columns, bad = _parse(plain.take(pa.array(mine)), mine, int(w))
            reason[bad] = "columns"
            if not len(got):
                continue
            columns = [pc.utf8_trim_whitespace(c) for c in columns]
            kind, value = classify(pa.concat_arrays(columns))
            kind, value = kind.reshape(w, -1).T, value.reshape(w, -1).T
            if lines:
                rows_of.append(got)
                for out, bits in zip(bits_of, ((kind == TEXT) | (kind == TIMESTAMP), (kind != TIMESTAMP) & (kind != MISSING))):
                    out.append(_words(bits))
                if known is not None:
                    pos = label_at[g[got]]
                    for p in np.unique(pos[pos >= 0]):
                        who = np.flatnonzero(pos == p)
                        ok_label[got[who]] = pc.is_in(normalized_labels(columns[p].take(pa.array(who))), known).to_numpy(zero_copy_only=False)
                if cells:
                    by_row = np.arange(w * len(got)).reshape(w, -1).T.ravel()
                    cells_of.append(pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * w), pa.concat_arrays(columns).take(pa.array(by_row))))
            pieces.append((got, columns, kind, value))
        if lines and n:
            empty = np.not_equal(reason, None)
            order = np.full(n, -1, np.int64)
            if rows_of:
                at = np.concatenate(rows_of)
                order[at] = np.arange(len(at))
            spread = lambda parts, kind: pa.concat_arrays(parts).cast(kind).take(pa.array(order, mask=order < 0)) if parts else pa.nulls(n, kind)  # noqa: B023, E731
            whole_bits, text_cells = [spread(b, pa.list_(pa.int64())) for b in bits_of], spread(cells_of, pa.list_(pa.string()))
            arrays = [pa.array(file_no[body], pa.int64()), pa.array(chunk_no[body], pa.int32()), pa.array(line_no[body], pa.int32()), pa.array(reason, pa.string()), *whole_bits, pa.array(ok_label, mask=empty), text_cells]
            out = pa.StructArray.from_arrays(arrays, fields=list(line_type))
            yield pa.RecordBatch.from_arrays([out, pa.nulls(n, stat_type)], names=["line", "stat"])
        if stats:
            rows = []
            seen = set()
            for got, columns, kind, value in pieces:
                gs = g[got]
                by = np.argsort(gs, kind="stable")
                cuts = np.flatnonzero(np.diff(gs[by], prepend=-1))
                for a, b in zip(cuts, [*cuts[1:], len(by)]):
                    who = by[a:b]
                    k, v = kind[who], value[who]
                    q = int(gs[who[0]])
                    seen.add(q)
                    rows += stat_rows(q, k, v, columns, who, bool(n_chunks[q] > 1))
            for q in range(len(names)):
                if q not in seen:
                    rows += stat_rows(q, np.zeros((0, int(widths[q])), np.int8), np.zeros((0, int(widths[q]))), None, None, False)
            for r in rows:
                q = r["file_no"]
                r.update(file_no=int(file_no[starts[q]]), chunk=int(chunk_no[starts[q]]), chunks=int(n_chunks[q]), name=names[q][r["position"]])
            if rows:
                stat = pa.array(rows, stat_type)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), line_type), stat], names=["line", "stat"])

    def stat_rows(q: int, k: np.ndarray, v: np.ndarray, columns: list | None, who: np.ndarray | None, values: bool) -> list[dict]:
        n, w = k.shape
        counts = [(k == c).sum(0) for c in range(6)]
        finite = np.isfinite(v)
        vf = np.where(finite, v, np.nan)
        vs = np.sort(vf, axis=0)  # NaN goes last
        nf = finite.sum(0)
        at = np.arange(w)
        lo, hi = np.maximum(nf - 1, 0) // 2, nf // 2
        none = nf == 0
        if n:
            median = np.where(none, np.nan, (vs[lo, at] + vs[np.minimum(hi, n - 1), at]) / 2)
            least, most = vs[0], vs[np.maximum(nf - 1, 0), at]
        else:
            median = least = most = np.full(w, np.nan)
        zero = np.where(finite, vf, 0)
        with np.errstate(divide="ignore", over="ignore"):
            ln = np.where(finite & (zero != 0), np.log(np.abs(np.where(zero == 0, 1, zero))), 0)
            total, lt, ls = zero.sum(0), ln.sum(0), (ln**2).sum(0)
            m2 = (np.where(finite, vf - total / np.maximum(nf, 1), 0) ** 2).sum(0)
        zeros, negatives, pos_inf = (finite & (vf == 0)).sum(0), (finite & (vf < 0)).sum(0), (v == np.inf).sum(0)
        out = []
        for j in range(w):
            fitting = []
            for p in patterns:
                fitting.append(int(pc.sum(pc.match_substring_regex(columns[j].take(pa.array(who)), p)).as_py() or 0) if n and counts[TEXT][j] else 0)
            hashed = None
            if hashes and n:
                got = columns[j].take(pa.array(who)).filter(pa.array(k[:, j] != MISSING)).unique().to_pylist()
                hashed = sorted(_hash64(x) for x in got)[:KMV]
            out.append(
                {
                    "file_no": q, "position": j, "lines": n, "missing": int(counts[MISSING][j]), "infinite": int(counts[INFINITE][j]), "whole": int(counts[WHOLE][j]), "decimals": int(counts[DECIMAL][j]),
                    "timestamps": int(counts[TIMESTAMP][j]), "texts": int(counts[TEXT][j]), "pos_inf": int(pos_inf[j]), "least": None if none[j] else float(least[j]), "most": None if none[j] else float(most[j]), "total": float(total[j]),
                    "m2": float(m2[j]), "zeros": int(zeros[j]), "negatives": int(negatives[j]), "median": None if none[j] else float(median[j]), "ln_total": float(lt[j]), "ln_squares": float(ls[j]),
                    "fitting": fitting, "values": vs[: nf[j], j].tolist() if values else None, "distinct_hashes": hashed,
                }
            )
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < BLOCK:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            f, c = t.column("file_no").to_numpy(), t.column("chunk").to_numpy()
            edge = np.flatnonzero((f[1:] != f[:-1]) | (c[1:] != c[:-1]))
            if not len(edge):
                continue  # one chunk of at most CHUNK lines, and copies of them
            cut = int(edge[-1]) + 1
            yield from block(t.slice(0, cut))
            held = t.slice(cut).to_batches()
            size = t.num_rows - cut
        if size:
            yield from block(pa.Table.from_batches(held))

    return chunked_lines(raw, chunk=chunk).mapInArrow(run, OUT_SCHEMA)


def _hash64(x: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big", signed=True)
