"""Quality rules from a table of thresholds, compiled into one projection.

A rule bounds a measure of a text, or its share of another measure in percent, from
below or above.  All rules of a table become one expression of built-in functions
over measures that are worked out once a row, so texts are read once, nothing is
shuffled and no Python runs.  Shares are compared as whole numbers (``100 * part``
with ``percent * whole``), so a verdict doesn't hang on rounding.

Measures: ``n_words`` (runs of characters other than space and U+0009 to U+000D),
``word_chars``, ``n_symbols``, ``n_stop_words``, ``n_lines`` (lines with a word),
``n_dup_lines`` (such lines that equal an earlier one), ``n_bullet_lines``,
``n_ellipsis_lines`` and ``n_repeat_words`` (words in windows of ``window`` words that
the text has twice or more, the first included).  Windows are compared by 64-bit
hashes; only texts in which a window repeats have theirs sorted to find the places.

Defined results: a null or empty text has no words, and a share of nothing breaks no
rule.  Repeated rows get equal results, null ids are no case of their own.  An input
column with the name of the result (``out_col``) is replaced by it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontam import _hashes, _once

SPACE = "\\x20\\x09-\\x0D"
SYMBOLS = "[#*$%&|<>]"
BULLETS = "^[ \\t]*[-*\\u2022\\u25cf]"
WINDOW = 8


class Rule(NamedTuple):
    """``low`` and ``high`` bound ``part``, or with ``whole`` its percentage of that."""

    name: str
    part: str
    whole: str | None
    low: int | None
    high: int | None


#: What every corpus asks for.
BASE = [
    Rule("too_few_words", "n_words", None, 20, None),
    Rule("repeated_windows", "n_repeat_words", "n_words", None, 30),
]
#: Chosen for languages that put spaces between words.
TABLE = [
    Rule("too_many_words", "n_words", None, None, 1_000_000),
    Rule("word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols", "n_symbols", "word_chars", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 5, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 30),
]
#: Very common function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is that for it was on with be as by this are at from or an not "
    "de la le et les des en un du une que pour est qui dans par pas au sur avec "
    "der die und den von zu das sich mit auf ist nicht im dem ein eine als auch es "
    "el y los se del las por no con su para al lo como más"
).split()


def broken(rule: Rule, measure=F.col) -> Column:
    """Does a row break the rule? ``measure`` gives the column of a measure's name."""
    value = measure(rule.part)
    scale = F.lit(1).cast("long")
    if rule.whole is not None:
        value, scale = value * 100, measure(rule.whole)
    out = F.lit(False)
    if rule.low is not None:
        out = out | (value < scale * rule.low)
    if rule.high is not None:
        out = out | (value > scale * rule.high)
    return out


def broken_rules(table: list[Rule], measure=F.col) -> Column:
    """The names of the rules of a table that a row breaks, in the table's order."""
    names = [r.name for r in table]
    if len(set(names)) < len(names):
        raise ValueError("two rules have one name")
    return F.array_compact(F.array(*[F.when(broken(r, measure), r.name) for r in table])) if table else F.array().cast("array<string>")


def _measured(df: DataFrame, keys: list[str], window: int, stop_words: list[str]) -> DataFrame:
    """``keys`` and the measures of ``text``, which isn't null."""
    text = F.col("text")
    long = lambda c: c.cast("long")
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    df = _once(
        df, keys, words=words, lines=lines, word_chars=long(F.char_length(F.regexp_replace(text, f"[{SPACE}]+", ""))),
        n_symbols=long(F.regexp_count(text, F.lit(SYMBOLS))),
    )
    own = [*keys, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines", "n_stop_words"]
    df = _once(
        df, [*keys, "word_chars", "n_symbols"], n_words=long(F.size("words")), n_lines=long(F.size("lines")),
        n_dup_lines=long(F.size("lines") - F.size(F.array_distinct("lines"))),
        n_bullet_lines=long(F.size(F.filter("lines", lambda x: x.rlike(BULLETS)))),
        n_ellipsis_lines=long(F.size(F.filter("lines", lambda x: x.rlike("(\\.\\.\\.|\\u2026)[ \\t\\r]*$")))),
        n_stop_words=long(F.size(F.filter("words", lambda x: F.lower(x).isin(stop_words)))),
        codes=F.transform("words", lambda x: F.xxhash64(x)),
    )
    df = _hashes(df, own, ["codes"], window)
    # Where windows repeat: sorted, equal ones stand side by side.
    again = F.size(F.array_distinct("codes")) < F.size("codes")
    df = _once(df, own, found=F.when(again, F.sort_array(F.transform("codes", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    twin = lambda p, i: F.coalesce(p["h"] == F.get("found", i - 1)["h"], F.lit(False)) | F.coalesce(p["h"] == F.get("found", i + 1)["h"], F.lit(False))
    df = _once(df, own, at=F.sort_array(F.transform(F.filter("found", twin), lambda p: p["i"])))
    till = lambda p, i: F.coalesce(F.least(F.get("at", i + 1) - p, F.lit(window)), F.lit(window))
    return df.select(*own, F.coalesce(F.aggregate(F.transform("at", till), F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"))


def judge(docs: DataFrame, table: list[Rule] = TABLE, base: list[Rule] = BASE, text_col: str = "text", window: int = WINDOW, stop_words: list[str] | None = None, out_col: str = "quality") -> DataFrame:
    """``docs`` with a struct ``quality``: the measures, ``base_failed``, ``kept`` and
    ``broken`` (names of the broken rules, those of ``base`` first).

    Every text is judged by both tables; it stays if it breaks no rule of either."""
    if window < 1:
        raise ValueError("a window has one word or more")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != out_col.lower()]
    own = docs.select(F.struct(*kept).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text")) if kept else docs.select(F.struct(F.lit(None).alias("none")).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    measured = _measured(own, ["row"], window, STOP_WORDS if stop_words is None else stop_words)
    names = [c for c in measured.columns if c != "row"]
    done = _once(measured, ["row", *names], low=broken_rules(base), rest=broken_rules(table))
    verdict = F.struct(*names, (F.size("low") > 0).alias("base_failed"), (F.size(F.concat("low", "rest")) == 0).alias("kept"), F.concat("low", "rest").alias("broken"))
    done = done.select("row", verdict.alias("done"))
    return done.select("row.*", F.col("done").alias(out_col)) if kept else done.select(F.col("done").alias(out_col))
