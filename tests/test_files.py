"""Lines, rejects, drift and quality on small files, against plain Python."""

import csv
import io
import math
import re

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from flowquarry.operators import linetable, quality, rejects, schemadrift
from flowquarry.operators.fieldnames import Fields, shortened, words

DICT = [("Flow ID", "text", None, None, "^[a-z]{2}[0-9]+$", ["flow_key"]), ("Timestamp", "timestamp", None, None, None, ["Time"]), ("Flow Duration", "whole", 0.0, 1000.0, None, ["duration_us"]), ("Flow Bytes/s", "decimal", 0.0, 1e6, None, []), ("Total Length of Fwd Packets", "whole", 0.0, 1e6, None, []), ("Label", "text", None, None, None, [])]
LABELS = ["benign", "ddos", "web attack - xss"]


def files_of(spark, texts, sensors=None, **how):
    """texts: file_no -> lines."""
    raw = spark.createDataFrame([(f, n + 1, t, "x") for f, ls in texts.items() for n, t in enumerate(ls)] or [], "file_no long, line_no int, line_text string, chunk string")
    sensors = sensors or {f: ("s", n + 1) for n, f in enumerate(sorted(texts))}
    rep = spark.createDataFrame([(f, s, q, len(texts.get(f, [])) - 1, 0) for f, (s, q) in sensors.items()] or [], "file_no long, sensor string, seq int, data_lines long, rows long")
    d = spark.createDataFrame(DICT, "column_name string, kind string, least double, most double, pattern string, aliases array<string>")
    return schemadrift.Files(raw, rep, d, LABELS, **how), rep


HEAD = "﻿ Flow ID, Timestamp,Flow Duration , Flow Bytes/s, Label\r"
GOOD = [f"ab{i},2030-01-0{i} 00:00:00,{i},{i}.5,BENIGN" for i in range(1, 9)]


def test_reject_reasons(spark):
    bad = [
        "Flow ID, Timestamp,Flow Duration , Flow Bytes/s, Label",  # not the same text as line 1
        " Flow ID, Timestamp,Flow Duration , Flow Bytes/s, Label",  # header
        'ab1,2030-01-01 00:00:00,"5,1.5,BENIGN',  # quoting: not closed
        'ab1,2030-01-01 00:00:00,"5"x,1.5,BENIGN',  # quoting: text after
        'ab1,2030-01-01 00:00:00,5",1.5,BENIGN',  # quoting: inside
        'ab1,2030-01-01 00:00:00,"5""",1.5,BENIGN',  # value, the quoting is fine
        "ab1,2030-01-01 00:00:00,5,BENIGN",  # columns
        "ab1,2030-01-01 00:00:00,5,1.5,BENIGN,",  # columns
        "ab1,2030-02-30 00:00:00,5,1.5,BENIGN",  # value: no such day
        "ab1,,NaN,-Infinity,Web Attack – XSS",  # fine
        "ab1,null,5us,1,BENIGN",  # value
        "ab1,na,5,1,BENIGNE",  # value: label
        "ab1,na,5,1,",  # value: label
        "   \t\r",  # blank
        'ab1,2030-01-01 00:00:00,"7",1e3, benign ',  # fine
    ]
    f, rep = files_of(spark, {7: [HEAD, *GOOD, *bad]})
    got = {r["line_no"] - 10: r["reason"] for r in rejects.judged_lines(f).collect() if r["line_no"] > 9}
    want = ["value", "header", "quoting", "quoting", "quoting", "value", "columns", "columns", "value", None, "value", "value", "value", "blank", None]
    assert got == dict(enumerate(want))
    b = rejects.load_balance(f, rep).first()
    assert (b["lines"], b["loaded"], b["blank"], b["header"], b["quoting"], b["columns"], b["value"], b["data_lines"]) == (23, 10, 1, 1, 3, 2, 6, 23)


def test_repeated_and_unordered_lines_and_chunks(spark):
    text = {1: [HEAD, *GOOD * 5]}
    lines = [(1, n + 1, t) for n, t in enumerate(text[1])]
    raw = spark.createDataFrame([*reversed(lines), *lines[:7], (None, 3, "x"), (1, None, "x"), (2, 5, "no header")], "file_no long, line_no int, line_text string")
    whole = linetable.parse_lines(raw, labels=LABELS).where("line is not null").select("line.file_no", "line.line_no", "line.reason")
    cut = linetable.parse_lines(raw, labels=LABELS, chunk=7).where("line is not null").select("line.file_no", "line.line_no", "line.reason")
    assert rows(whole) == rows(cut) == sorted([(1, n, None) for n in range(2, 42)] + [(2, 5, "columns")], key=lambda t: (t[0], str(t[1])))
    one = schemadrift.file_columns(linetable.parse_lines(raw, chunk=10_000).where("stat is not null").select("stat.*"))
    stats = linetable.parse_lines(raw, chunk=7).where("stat is not null").select("stat.*")
    many = schemadrift.whole_columns(schemadrift.file_columns(stats), stats)
    cols = ["file_no", "position", "name", "lines", "missing", "whole", "decimals", "timestamps", "texts", "least", "most", "median", "observed"]
    assert rows(one.select(*cols)) == rows(many.select(*cols))


def test_changes_and_issues(spark):
    first = ["Flow ID,Timestamp,Flow Duration,Flow Bytes/s,Label", *[f"ab{i},2030-01-01 00:00:0{i},{i + 10},{i}.5,BENIGN" for i in range(8)]]
    # renamed and retyped duration, bytes removed, a new column, constant and shifted values
    second = ["Flow Dur,Flow ID,Timestamp,Total Length of Fwd Packets,Label", *[f"{900 + 200 * (i == 1)}.5,{'??' if i == 2 else 'ab1'},2030-01-01 00:00:00,5,BENIGN" for i in range(8)]]
    third = ["Flow Dur,Flow ID,Timestamp,Total Length of Fwd Packets,Label", *["900.5,ab1,,7,BENIGN"] * 5, *["null,ab1,,inf,BENIGN"] * 2, *["x,ab1,,7,BENIGN"]]
    f, _ = files_of(spark, {1: first, 2: second, 3: third})
    assert rows(schemadrift.schema_changes(f)) == sorted([(2, "added", "Total Length of Fwd Packets"), (2, "removed", "Flow Bytes/s"), (2, "renamed", "Flow Dur"), (2, "retyped", "Flow Dur")])
    assert set(rows(quality.quality_issues(f))) == {(2, "Flow Dur", "range"), (2, "Flow ID", "pattern"), (2, "Flow Dur", "shift"), (3, "Flow Dur", "unparseable"), (3, "Flow Dur", "missing"), (3, "Flow Dur", "constant"), (3, "Total Length of Fwd Packets", "infinite")}
    fused = {r["field"]: (r["canonical"], [a["kind"] for a in r["alternatives"]]) for r in schemadrift.unified_schema(f).collect()}
    assert fused["Flow Duration"] == ("decimal", ["decimal", "whole"])
    assert fused["Timestamp"] == ("timestamp", ["timestamp"])  # the last file's empty column keeps its kind


def test_kinds_are_kept_through_empty_files(spark):
    head = "Flow ID,Timestamp,Label"
    texts = {1: [head, "ab1,2030-01-01 00:00:00,BENIGN"]} | {n: [head, "ab1,,BENIGN"] for n in range(2, 7)} | {7: [head, "ab1,12,BENIGN"]}
    f, _ = files_of(spark, texts)
    assert {r["kind"] for r in f.columns.where("name = 'Timestamp' and file_no < 7").collect()} == {"timestamp"}
    assert rows(schemadrift.schema_changes(f)) == [(7, "retyped", "Timestamp")]


def test_profiles_and_recorded_ones(spark):
    f, _ = files_of(spark, {1: ["Flow ID,Flow Duration,Label", "ab1,4,BENIGN", "ab1,6,BENIGN", "ab1,,BENIGN", "ab2,-inf,BENIGN", "ab3,2,BENIGN", "ab3,0,BENIGN", "ab3,0,BENIGN", "ab3,x,BENIGN"], 2: ["Flow Duration", "NaN"]}, hashes=True)
    p = quality.column_profiles(f).cache()
    d = {(r["file_no"], r["column_name"]): r for r in p.collect()}
    x = d[(1, "Flow Duration")]
    assert (x["lines"], x["missing"], x["infinite"], x["pos_inf"], x["other_cells"], x["finite_count"], x["least"], x["most"], x["median"], x["zeros"], x["distinct"], x["constant"]) == (8, 1, 1, 0, 1, 5, 0, 6, 2, 2, 6, False)
    assert math.isclose(x["mean"], 2.4) and math.isclose(x["std"], math.sqrt(6.8))
    y = d[(2, "Flow Duration")]
    assert (y["finite_count"], y["mean"], y["std"], y["median"], y["distinct"], y["kind"]) == (0, None, None, None, 0, "whole")
    rec = spark.createDataFrame([(1, "Flow Duration", 5, 2, 0, 1, 2, 0, 1, 0.0, 6.0)] * 2 + [(2, "Flow Duration", 1, 1, 0, 0, 0, 0, 0, None, None), (9, "gone", *[0] * 7, None, None)], "file_no long, column_name string, finite_count long, nan long, pos_inf long, neg_inf long, zeros long, negatives long, unparseable long, min double, max double")
    assert {(r["file_no"], r["measure"]) for r in quality.recorded_differences(p, rec).collect() if r["file_no"] < 9} == {(2, "finite_count")}


def test_control_limits(spark):
    head = "Flow ID,Flow Duration,Label"
    texts = {n: [head, *[f"ab1,{100 + n % 3 if n != 11 else 900},BENIGN"] * 4, "ab1,,BENIGN"] for n in range(1, 13)}
    texts[9] = [head, *["ab1,101,BENIGN"] * 2, *["ab1,,BENIGN"] * 3]
    f, rep = files_of(spark, texts)
    whole = quality.control_limits(f, rep)
    assert {(r["file_no"], r["metric"]) for r in whole.where("outside").collect()} == {(9, "lost"), (11, "median")}
    assert {r["file_no"] for r in whole.where("outside is null").collect()} == {1, 2, 3, 4}
    short = dict(history=3, least=2)
    assert rows(quality.control_limits(f, rep, **short)) == rows(quality.control_limits(f, rep, span=4, **short))


def test_late_and_repeated_reports(spark):
    head, row = "Flow ID,Label", "ab1,BENIGN"
    raw = {10: [head, row], 11: ["Flow ID,Label,Time", row + ","], 12: [head, row]}
    f, _ = files_of(spark, raw, {12: ("a", 1), 10: ("a", 2), 11: ("b", 9)})
    assert rows(schemadrift.schema_changes(f)) == []


def test_unified_rows(spark):
    f, _ = files_of(spark, {1: ["Flow ID,Flow Duration,Other,Label", "ab1,5,q,BENIGN", "ab2,5us,,BENIGN", *["ab9,5,,BENIGN"] * 3], 2: ["Label,duration_us,flow_key", "DDoS,1e2,ab3"]}, cells=True)
    got = {r["Flow ID"]: (r["Flow Duration"], r["as_text"]) for r in schemadrift.unified_rows(f).collect()}
    assert got == {"ab1": (5.0, {"other": "q"}), "ab2": (None, {"Flow Duration": "5us"}), "ab3": (100.0, {}), "ab9": (5.0, {})}


def test_empty_tables(spark):
    f, rep = files_of(spark, {})
    for df in (schemadrift.schema_changes(f), rejects.judged_lines(f), quality.quality_issues(f), quality.column_profiles(f), schemadrift.unified_schema(f)):
        assert df.collect() == []


def test_long_lines_and_wide_files(spark):
    wide = ",".join(f"c{i}" for i in range(130)) + ",Label"
    f, _ = files_of(spark, {1: [wide, ",".join(["1"] * 130) + ",BENIGN", ",".join(["1"] * 129 + ["x"]) + ",BENIGN", *[",".join(["2"] * 130) + ",BENIGN"] * 4, "z" * 3_000_000]})
    got = {r["line_no"]: r["reason"] for r in rejects.judged_lines(f).collect()}
    assert got == {2: None, 3: "value", 4: None, 5: None, 6: None, 7: None, 8: "columns"}


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet='a",x ', max_size=14))
def test_quoting_rule(line):
    def plain(text):
        state = "start"
        for c in text:
            if state == "start":
                state = "start" if c == "," else "quoted" if c == '"' else "bare"
            elif state == "bare":
                if c == '"':
                    return False
                state = "start" if c == "," else "bare"
            elif state == "quoted":
                state = "maybe" if c == '"' else "quoted"
            else:
                if c not in '",':
                    return False
                state = "quoted" if c == '"' else "start"
        return state != "quoted"

    assert bool(re.search(linetable._GOOD_QUOTES, line)) == plain(line)
    if plain(line) and line.strip():
        assert len(next(csv.reader(io.StringIO(line)))) >= 1


@pytest.mark.parametrize("cell,code,value", [("5", 2, 5), ("+5", 2, 5), ("-5.", 3, -5), (".5", 3, 0.5), ("1e-3", 3, 0.001), ("", 0, None), ("NaN", 0, None), ("nUll", 0, None), ("inf", 1, math.inf), ("-Infinity", 1, -math.inf), ("2030-02-29 00:00:00", 5, None), ("2032-02-29 23:59:59", 4, None), ("2030-01-01 24:00:00", 5, None), ("1,5", 5, None), (".", 5, None), ("1e", 5, None)])
def test_cells(cell, code, value):
    import pyarrow as pa

    kind, number = linetable.classify(pa.array([cell]))
    assert kind[0] == code
    assert (math.isnan(number[0]) if value is None else number[0] == value)


def test_field_names():
    f = Fields({"Flow Duration": ["duration_us"], "Flow IAT Mean": [], "Active Mean": [], "Total Length of Fwd Packets": [], "Fwd Header Length": [], "Fwd Header Length.1": [], "Flow Packets/s": [], "Timestamp": ["Time"], "Note": ["Remarks"], "Label": []}, {"Flow Dur": "Flow Duration"})
    for name, field, sure in (("Flow Dur", "Flow Duration", 0.9), ("FLOW DURATION", "Flow Duration", 1), ("flow_packets_s", "Flow Packets/s", 1), ("Fwd Header Length.1", "Fwd Header Length.1", 1), ("Flow Dur.1", "Flow Duration.1", 0.9), ("Unheard Of", "unheardof", 0)):
        assert f.of(name) == (field, sure), name
    assert words("TotLen FwdIAT_x2") == ["tot", "len", "fwd", "iat", "x"]
    assert shortened("pkts", "packets") == 0.8 and shortened("dur", "duration") == 0.9 and shortened("std", "total") == 0
    assert f.likeness("Tot Len Fwd Pkts", "Total Length of Fwd Packets") > 0.55 > f.likeness("Tot Len Fwd Pkts", "Fwd Header Length")
    assert linetable.header_names("\ufeffa , a,b,a.1, a\r\n") == ["a", "a.1", "b", "a.1.1", "a.2"]


def test_evidence_for_names():
    f = Fields({"Flow Duration": ["duration_us"], "Note": [], "Idle Mean": [], "Active Mean": []})
    names = ["Flow Duration", "duration_us", "Note", "Idle Mean", "Active Mean", "Comment", "Act Mean", "Span", "New One", "Old", "Elder"]
    swaps = {("Comment", "Note"): (4, 0.9), ("Span", "Idle Mean"): (3, 0.1), ("Span", "Flow Duration"): (2, 0.9), ("New One", "Idle Mean"): (1, 0.2), ("Elder", "Old"): (5, 0.9), ("Old", "Elder"): (5, 0.9)}
    changes = {"Comment": 4, "Span": 4, "New One": 1, "Elder": 5, "Old": 5}
    got = f.resolve(names, swaps, changes, {("Act Mean", "Idle Mean"), ("Span", "Idle Mean")}, {("Act Mean", "Active Mean"): 0.9})
    assert got["Comment"] == "Note" and got["Act Mean"] == "Active Mean" and got["Span"] == "Flow Duration"
    assert "New One" not in got and got["Old"] == got["Elder"]
    assert f.resolve([], {}, {}, set(), {}) == {}


def test_renames_without_a_list(spark):
    """A name that nothing is known of: the column that comes when another goes, with the same values, is its field."""
    texts = {}
    for n in range(1, 9):
        name = "Span" if n in (3, 4, 7) else "Flow Duration"
        texts[n] = [f"Flow ID,{name},Flow Bytes/s,Label", *[f"ab1,{100 + i},{i}.5,BENIGN" for i in range(6)]]
    texts[9] = ["Flow ID,Flow Duration,Extra,Label", *[f"ab1,{100 + i},text {i},BENIGN" for i in range(6)]]
    f, _ = files_of(spark, texts)
    assert f.found == {"Span": "Flow Duration"}
    assert rows(schemadrift.schema_changes(f)) == sorted([(3, "renamed", "Span"), (5, "renamed", "Flow Duration"), (7, "renamed", "Span"), (8, "renamed", "Flow Duration"), (9, "added", "Extra"), (9, "removed", "Flow Bytes/s")])


def test_three_kinds_of_one_field(spark):
    head = "Flow ID,Flow Duration,Label"
    f, _ = files_of(spark, {1: [head, "ab1,5,BENIGN", "ab2,inf,BENIGN"], 2: [head, "ab3,1.5,BENIGN"], 3: [head, "ab4,2030-01-01 00:00:00,BENIGN", "ab5,7,BENIGN"] + ["ab6,2030-01-01 00:00:01,BENIGN"] * 8}, cells=True)
    u = schemadrift.unified_rows(f)
    assert {c: t for c, t in u.dtypes if c.startswith("Flow Duration")} == {"Flow Duration": "string", "Flow Duration:decimal": "double", "Flow Duration:timestamp": "timestamp", "Flow Duration:whole": "bigint"}
    got = {r["Flow ID"]: r for r in u.collect()}
    assert (got["ab1"]["Flow Duration"], got["ab1"]["Flow Duration:whole"], got["ab1"]["Flow Duration:decimal"]) == ("5", 5, None)
    assert got["ab2"]["Flow Duration"] == "inf" and got["ab2"]["Flow Duration:whole"] is None
    assert got["ab3"]["Flow Duration:decimal"] == 1.5 and got["ab4"]["Flow Duration:timestamp"].year == 2030 and got["ab5"]["Flow Duration:timestamp"] is None
    assert got["ab5"]["Flow Duration"] == "7" and got["ab5"]["as_text"] == {}


def test_failing_columns_and_typed_rows(spark):
    f, _ = files_of(spark, {1: [HEAD, *GOOD, "ab1,2030-01-01 00:00:00,x,y,BENIGN", "ab1,5,1,1,nope", "ab1,,NaN,-inf,BENIGN"]}, cells=True)
    judged = {r["line_no"]: (r["reason"], r["failing"]) for r in rejects.judged_lines(f).collect()}
    assert judged[2] == (None, None) and judged[10] == ("value", ["Flow Duration", "Flow Bytes/s"]) and judged[11] == ("value", ["Timestamp", "Label"])
    got = {r["line_no"]: r for r in rejects.loaded_rows(f).collect()}
    assert got[2]["numbers"] == {"Flow Duration": 1.0, "Flow Bytes/s": 1.5} and got[2]["timestamps"]["Timestamp"].day == 1 and got[2]["texts"] == {"Flow ID": "ab1", "Label": "BENIGN"}
    assert got[12]["numbers"] == {"Flow Bytes/s": -math.inf} and got[12]["timestamps"] == {} and 10 not in got


@pytest.mark.parametrize("chunk", [20_000, 3])
def test_moments_of_large_means(spark, chunk):
    vals = [1e9, 1e9 + 1, 1e9 + 2, 1e9 + 7, 1e9 - 3, 1e9, 1e9 + 1]
    raw = spark.createDataFrame([(1, 1, "Flow Duration,Label")] + [(1, n + 2, f"{v},BENIGN") for n, v in enumerate(vals)], "file_no long, line_no int, line_text string")
    stats = linetable.parse_lines(raw, chunk=chunk).where("stat is not null").select("stat.*").cache()
    (c,) = schemadrift.whole_columns(schemadrift.file_columns(stats), stats).where("name = 'Flow Duration'").collect()
    mean = sum(vals) / len(vals)
    assert math.isclose(c["m2"], sum((v - mean) ** 2 for v in vals), rel_tol=1e-8) and c["median"] == 1e9 + 1


def test_distinct_beyond_the_sketch(spark):
    f, _ = files_of(spark, {1: ["Flow Duration,Label", *[f"{i % 700},BENIGN" for i in range(2000)]]}, hashes=True)
    exact = {r["column_name"]: (r["distinct"], r["distinct_exact"], r["distinct_error"]) for r in quality.column_profiles(f).collect()}
    assert exact == {"Flow Duration": (700, True, 0.0), "Label": (1, True, 0.0)}
    f.raw = None  # states only
    (est,) = quality.column_profiles(f).where("column_name = 'Flow Duration'").collect()
    assert not est["distinct_exact"] and abs(est["distinct"] - 700) <= est["distinct_error"] < 150


def test_states_of_loads_add_up(spark, tmp_path):
    head = "Flow ID,Flow Duration,Label"
    texts = {n: [head, *[f"ab1,{n * 100 ** (n % 3)},BENIGN"] * 5] for n in range(1, 7)}
    whole, rep = files_of(spark, texts)
    raw, path = whole.raw, str(tmp_path / "states")
    for part in ("file_no <= 2", "file_no > 2"):
        states = schemadrift.parse_states(raw.where(part), whole.column_dict, LABELS, lines=False, path=path)
    by_loads = schemadrift.Files(None, rep, whole.column_dict, states=states)
    assert rows(quality.quality_issues(by_loads)) == rows(quality.quality_issues(whole)) != []


def test_limits_of_a_field_that_comes_and_goes(spark):
    texts = {n: ["Flow ID,Flow Duration,Label" if n % 5 == 0 else "Flow ID,Label", *([f"ab1,{100 + n % 3},BENIGN"] * 3 if n % 5 == 0 else ["ab1,BENIGN"] * 3)] for n in range(1, 61)}
    f, rep = files_of(spark, texts)
    want = rows(quality.control_limits(f, rep, history=3, least=2))
    assert rows(quality.control_limits(f, rep, history=3, least=2, span=4)) == want
    assert len([r for r in want if r[3] == "median" and r[8] is not None]) == 10


def test_own_checks_and_several_patterns(spark):
    texts = {1: ["Flow ID,Time,Label", "ab1,x1,BENIGN", "??,x2,BENIGN", "ab3,y,BENIGN"]}
    raw = spark.createDataFrame([(f, n + 1, t) for f, ls in texts.items() for n, t in enumerate(ls)], "file_no long, line_no int, line_text string")
    rep = spark.createDataFrame([(1, "s", 1)], "file_no long, sensor string, seq int")
    d = spark.createDataFrame([("Flow ID", "text", None, None, "^[a-z]{2}[0-9]+$", []), ("Time", "text", None, None, "^x[0-9]$", []), ("Label", "text", None, None, "^BENIGN$", [])], "column_name string, kind string, least double, most double, pattern string, aliases array<string>")
    f = schemadrift.Files(raw, rep, d, LABELS)
    assert rows(quality.quality_issues(f)) == [(1, "Flow ID", "pattern"), (1, "Time", "pattern")]
    assert rows(quality.quality_issues(f, [quality.Check("odd", "pattern")])) == [(1, "Flow ID", "odd"), (1, "Time", "odd")]
    with pytest.raises(ValueError):
        quality.quality_issues(f, [quality.Check("x", "unknown")])
