"""Text statistics, exact ranks and the verdict on prose."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowquarry.llm import textquality as Q
from flowquarry.llm.textstats import STATISTICS, Tokens, block_statistics, blocks, common_table, word_hashes

WORDS = [("en", w) for w in ("the", "of", "was", "and", "in", "to")] + [("de", w) for w in ("der", "und", "war", "nicht")]


def sentence(rng):
    who, what, where = (str(rng.choice(x)) for x in (["operator", "night crew", "sensor", "analyst"], ["restarted", "checked", "lost", "moved"], ["gateway", "collector", "printer", "server"]))
    return f"The {who} {what} the {where} and it was in the old case of the {rng.choice(['branch', 'office'])}."


def junk(rng):
    kind = rng.integers(0, 4)
    n = int(rng.integers(4, 12))
    if kind == 0:
        return "\n".join(f"- {rng.choice(['gateway', 'printer', 'queue'])}" for _ in range(n))
    if kind == 1:
        return "\n".join(f"{rng.integers(1e5)};{rng.integers(100)};{rng.choice(['rack', 'cable'])}" for _ in range(n))
    if kind == 2:
        return "\n".join("".join(rng.choice(list("asdfjkl;"), 12)) for _ in range(n))
    return "the same again " * n * 5


def corpus(n=260, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, junk(rng) if i % 4 == 0 else " ".join(sentence(rng) for _ in range(int(rng.integers(1, 6)))), str(rng.choice(["en", " EN", None, "xx"])), int(i % 4 != 0)) for i in range(n)]


def test_verdicts_on_held_out_documents(spark):
    data = corpus()
    more = [(900, None, "en", 1), (901, "  \n ", "en", 0), (902, "word " * 40_000, "en", 0), (903, data[1][1], "en", 1), (904, data[1][1], "en", 1)]
    docs = spark.createDataFrame([d[:3] for d in data + more], "doc_id long, text string, lang string").withColumn("row", F.lit("clash")).withColumn("words", F.lit(1))
    labels = spark.createDataFrame([(i, r, p) for i, _, _, p in data[:160] for r in ("a", "b")] + [(5, "c", 0), (None, "c", 1), (6, "c", None)], "doc_id long, reader string, prose byte")
    common = spark.createDataFrame(WORDS, "lang string, word string")
    got = {r["doc_id"]: r for r in Q.quality_scores(docs, labels, common).collect()}
    assert 900 not in got and 901 not in got
    held = [(got[i]["not_prose"] >= 0.5) == (p == 0) for i, _, _, p in data[160:]]
    assert np.mean(held) > 0.95
    assert got[902]["not_prose"] > 0.5 and got[902]["words"] == 40_000
    assert got[903]["not_prose"] == got[904]["not_prose"]
    assert got[data[1][0]]["language"] == "en"


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "the end of the day was in the past", "en"), (2, "x", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, reader string, prose byte")
    common = spark.createDataFrame(WORDS, "lang string, word string")
    assert Q.quality_scores(docs, labels, common).count() == 2
    assert Q.quality_scores(docs.limit(0), labels, common).count() == 0


def test_exact_tails(spark):
    rng = np.random.default_rng(3)
    data = [(str(rng.choice(["a", "b", "b", "b"])), float(rng.choice([0.0, 0.0, 0.0, 1.5, rng.random()])), i) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, v double, i long").repartition(5)
    got = Q.exact_tails(df, ["k"], "v", "i").collect()
    assert sorted((r["k"], r["v"], r["i"]) for r in got) == sorted(data)
    for r in got:
        v = np.array([x for g, x, _ in data if g == r["k"]])
        assert math.isclose(r["at_most"], (v <= r["v"]).mean()) and math.isclose(r["at_least"], (v >= r["v"]).mean())
    assert Q.exact_tails(df.limit(0), ["k"], "v", "i").collect() == []


def test_one_value_over_all_ranges(spark):
    df = spark.range(4000).selectExpr("'a' as k", "case when id < 10 then -1d when id >= 3990 then 2d else 0d end as v", "id as i").repartition(7)
    got = Q.exact_tails(df, ["k"], "v", "i").groupBy("v", "at_most", "at_least").count().orderBy("v").collect()
    assert [tuple(r) for r in got] == [(-1.0, 10 / 4000, 1.0, 10), (0.0, 3990 / 4000, 3990 / 4000, 3980), (2.0, 1.0, 10 / 4000, 10)]


def test_scores_combine_tails(spark):
    docs = spark.createDataFrame([(1, "a", "en"), (2, "b c", "en"), (3, "d e f", "en")], "doc_id long, text string, lang string")
    stats = Q.document_statistics(docs, spark.createDataFrame(WORDS, "lang string, word string"), np.zeros(0, np.uint64))
    got = Q.outlier_scores(stats).collect()
    for r in got:
        assert math.isclose(r["low_words"], -math.log(r["words"] / 3)) and math.isclose(r["high_words"], -math.log((4 - r["words"]) / 3))
        assert math.isclose(r["outlier"], np.mean([max(r[f"low_{s}"], r[f"high_{s}"]) for s in STATISTICS]))


def one(text, lang="en"):
    words = {}
    for k, w in WORDS:
        words.setdefault(k, set()).add(w)
    langs, x = block_statistics(pa.array([text]), [lang], common_table(words), np.zeros(0, np.uint64))
    return langs[0], dict(zip(STATISTICS, x[0].tolist()))


def test_statistics_of_a_text():
    lang, s = one("The end of 25 days.\n- one item\n- one item\n- one item\n\nWas it in the Übung?")
    assert lang == "en" and s["words"] == 4 + 6 + 5
    assert math.isclose(s["mean_word_length"], (3 + 3 + 2 + 4 + 3 * 7 + 3 + 2 + 2 + 3 + 5) / 15)
    solid = len("Theendof25days.-oneitem-oneitem-oneitemWasitintheÜbung?")
    assert math.isclose(s["symbol_ratio"], 5 / solid) and math.isclose(s["digit_ratio"], 2 / solid)
    assert math.isclose(s["punctuated_lines"], 2 / 5) and math.isclose(s["words_per_line"], 3)
    assert math.isclose(s["common_words"], 5 / 15)
    assert math.isclose(s["repeated_lines"], 3 * len("-oneitem") / solid)
    assert math.isclose(s["capital_words"], 1 / 15)
    assert s["sentence_share"] == 0.0 and one("It was the end of the very long day.")[1]["sentence_share"] == 1.0
    assert math.isclose(one("x9z a#b don't")[1]["mixed_words"], 3 / 11) and one("well-known don't (yes)")[1]["mixed_words"] == 0
    assert one("a b")[1]["different_words"] == 1.0 and one("a b " * 10)[1]["different_words"] == 2 / 18


def test_languages_and_characters():
    assert one("der und war nicht", None)[0] == "de" and one("zzz", "fr")[0] == "und"
    assert word_hashes(["ÉTÉ", "Maß"]).tolist() == Tokens(pa.array(["été", "maß"])).word.tolist()
    t = Tokens(pa.array(["a\u00a0b \u4e2d\u6587 \U0001f600!", "", "é"]))
    assert t.doc.tolist() == [0, 0, 0, 0, 0, 2] and t.length.tolist() == [1, 1, 2, 1, 1, 1]


def test_blocks_do_not_change_statistics():
    data = [t for _, t, _, _ in corpus(60, 4)] + ["word " * 300_000]
    words = common_table({"en": {"the", "of"}})
    whole = block_statistics(pa.array(data), ["en"] * len(data), words, np.zeros(0, np.uint64))[1]
    assert [b - a for a, b in blocks(pa.array(data))] == [60, 1]
    for i in (0, 17, 60):
        assert np.allclose(block_statistics(pa.array([data[i]]), ["en"], words, np.zeros(0, np.uint64))[1][0], whole[i])


def test_pairs_of_prose(spark):
    docs = spark.createDataFrame([(1, "the end of it", "x"), (2, "the end", "x"), (3, "rack 5", "x"), (4, None, "x")], "doc_id long, text string, clash string")
    sample = spark.createDataFrame([(1, 0.0), (2, 0.5), (3, 1.0), (4, 0.0)], "doc_id long, junk double")
    got = Q.prose_pairs(docs, sample)
    assert set(got.tolist()) == set(Tokens(pa.array(["the end of it"])).pairs().tolist())
    assert len(Q.prose_pairs(docs, sample.limit(0))) == 0


def test_sample_of_labels_is_bounded(spark):
    labels = spark.createDataFrame([(i, "a", p) for i, _, _, p in corpus(120)], "doc_id long, reader string, prose byte")
    got = Q.labelled_sample(labels, 40)
    assert len(got) == 40 and got == Q.labelled_sample(labels.repartition(2), 40) and sum(x[2] for x in got) == 20


def test_verdict_without_a_statistic(spark):
    data = corpus(200)
    docs = spark.createDataFrame([d[:3] for d in data], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, "a", p) for i, _, _, p in data[:140]], "doc_id long, reader string, prose byte")
    got = {r["doc_id"]: r["not_prose"] >= 0.5 for r in Q.quality_scores(docs, labels, spark.createDataFrame(WORDS, "lang string, word string"), without=["unread_pairs"]).collect()}
    assert np.mean([got[i] == (p == 0) for i, _, _, p in data[140:]]) > 0.9
