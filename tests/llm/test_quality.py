import os
import re
from collections import Counter

import duckdb
import pytest

from pressmill.llm import queries, quality
from tests.test_oracles import _rows

SF = "/root/testdata/sf0.001"
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words"]


def plain(text, window=8):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    seen = Counter(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    inside = {i + k for i in range(len(words) - window + 1) if seen[tuple(words[i : i + window])] > 1 for k in range(window)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(lines), sum(w.lower() in quality.STOP_WORDS for w in words)]


CASES = [
    None, "", " \t\n", " ", "one", "a\rb\x0bc\x0cd  e", "x " * 20, "x " * 7, "x " * 8, "x " * 9,
    "a b c d e f g h 1 a b c d e f g h 2 b c d e f g h 2 b", "same\nsame\n same\n\n \nsame", "# * $ % & | < >", "\U0001f600 \U0001f600\U0001f600 naïve", "w " * 30000,
    "- one\n* two\n• three\nfour...", " ".join(f"w{i % 9}" for i in range(40)), " ".join(f"w{i}" for i in range(300)),
]


@pytest.mark.parametrize("window", [8, 3, 1])
def test_measures_equal_a_plain_version(spark, window):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "doc_id int, text string")
    got = {r["doc_id"]: [r["quality"][n] for n in NAMES] for r in quality.judge(df, window=window).collect()}
    assert [got[i] for i in range(len(CASES))] == [plain(t, window) for t in CASES]


def test_verdicts_and_clashing_names(spark):
    good = "the quick brown fox jumps over the lazy dog and runs into the wood that is on the hill by a lake with cold water"
    rows = [(None, good, "x"), (None, good, "x"), (1, good + " #########" * 9, None), (2, "too short", "y"), (3, None, None), (4, good.replace("the", "zog").replace("and", "zug"), "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality string").selectExpr("doc_id", "text", "quality", "1 AS row", "2 AS words", "3 AS codes", "4 AS done", "5 AS found", "6 AS `a.b`")
    out = quality.judge(df)
    assert out.columns == ["doc_id", "text", "row", "words", "codes", "done", "found", "a.b", "quality"]
    got = [(r["doc_id"], r["quality"]["kept"], r["quality"]["base_failed"], r["quality"]["broken"]) for r in out.collect()]
    assert got == [(None, True, False, [])] * 2 + [(1, False, False, ["symbols"]), (2, False, True, ["too_few_words", "stop_words"]), (3, False, True, ["too_few_words"]), (4, True, False, [])]
    assert quality.judge(df.limit(0)).count() == 0
    assert all(r["quality"]["kept"] for r in quality.judge(df, table=[], base=[]).collect())
    with pytest.raises(ValueError):
        quality.broken_rules([quality.TABLE[0], quality.TABLE[0]])


def test_thresholds_are_exact_at_their_bounds(spark):
    rule = [quality.Rule("share", "n_stop_words", "n_words", 25, 50)]
    df = spark.createDataFrame([(f"the {'x ' * n}",) for n in (0, 1, 2, 3, 4)], "text string")
    assert [r["quality"]["broken"] for r in quality.judge(df, table=rule, base=[]).collect()] == [["share"], [], [], [], ["share"]]


def test_one_projection_without_python_or_shuffle(spark):
    plan = quality.judge(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_query_equals_sql_and_keeps_prose(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'" if os.path.isfile(f"{SF}/documents.parquet") else f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet/*.parquet'")
    ours, theirs = queries.QUERIES["op11_quality_rules"](spark, SF).toPandas(), con.sql(queries.ORACLE["op11_quality_rules"]).df()
    assert _rows(ours) == _rows(theirs)
    assert 0.7 < ours["kept"].mean() < 0.95
