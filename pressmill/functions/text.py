"""Text and list functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Negations that stop-word removal leaves in place.
NEGATIONS = ["not", "no", "nor", "never", "neither", "n't", "nothing", "nobody", "nowhere"]
#: English function words; pass a list or an array column for other needs.
STOP_WORDS = """a about above after again against all am an and any are as at be because been before being below between both but by can cannot could did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself neither never no nobody nor not nothing now nowhere of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves""".split()
TOKEN = "[\\p{L}\\p{N}_]{2,}"


#: What Unicode and Python take for white space.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def stripped(c: Column) -> Column:
    """Without white space at its ends."""
    return F.btrim(c, F.lit(WHITE))


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(stripped(c), F.lit("")) == ""


def clean_text(c: Column) -> Column:
    """White space collapsed and trimmed; blank becomes null."""
    return F.nullif(F.trim(F.regexp_replace(c, f"[{WHITE}]+", " ")), F.lit(""))


def strip_dateline(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "^[A-Z\\s,.]+—", ""))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), "\\s+"), lambda x: x != ""))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), 0)


def mask_spans(text: Column, spans: Column, labels: list[str]) -> Column:
    """Replace spans ``(start, end, label)`` (0-based, end excluded) by ``[label]``.

    Positions are those of the given text; its dateline goes first and spans in it
    are ignored.  Later spans are replaced first, so that positions hold."""
    cut = F.char_length(text) - F.char_length(F.ltrim(F.regexp_replace(text, "^[A-Z\\s,.]+—", "")))
    body = strip_dateline(text)
    usable = F.filter(spans, lambda s: s["label"].isin(labels) & (s["start"] >= cut))
    last_first = F.reverse(F.array_sort(usable))
    masked = F.aggregate(last_first, body, lambda t, s: F.overlay(t, F.concat(F.lit("["), s["label"], F.lit("]")), s["start"] - cut + 1, s["end"] - s["start"]))
    return F.trim(F.regexp_replace(masked, "\\s+", " "))


def mask_patterns(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Mask what regular expressions find: ``(pattern, label)`` in order."""
    out = strip_dateline(text)
    for pattern, label in rules:
        out = F.regexp_replace(out, pattern, f"[{label}]")
    return F.trim(F.regexp_replace(out, "\\s+", " "))


def parse_sections(c: Column) -> Column:
    """A list literal, or plain text (split at commas), as an array without blanks."""
    plain = F.split(c, ",")
    listed = F.from_json(c, "array<string>", {"allowSingleQuotes": "true"})
    got = F.when(F.startswith(stripped(c), F.lit("[")), F.coalesce(listed, F.array(c))).otherwise(plain)
    return F.coalesce(F.filter(F.transform(got, stripped), lambda x: x != ""), F.array().cast("array<string>"))


def bag_of_words(c: Column, stop_words: list[str] | Column = STOP_WORDS, keep: list[str] = NEGATIONS, lemmas: Column | None = None) -> Column:
    """Lower, drop what is neither word nor space, lemmatise by a map, then drop stop
    words other than ``keep``."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}_\\s]", " "), "\\s+"), lambda x: x != "")
    if lemmas is not None:
        words = F.transform(words, lambda x: F.coalesce(F.element_at(lemmas, x), x))
    if isinstance(stop_words, Column):
        return F.array_join(F.filter(words, lambda x: ~F.array_contains(stop_words, x) | x.isin(keep)), " ")
    drop = [w for w in stop_words if w not in keep]
    return F.array_join(F.filter(words, lambda x: ~x.isin(drop)), " ")


def distinct_ignoring_case(values: Column) -> Column:
    """First spelling of each value in order; white space collapsed, blanks dropped."""
    tidy = F.filter(F.transform(values, clean_text), lambda x: x.isNotNull())
    return F.aggregate(tidy, F.array().cast("array<string>"), lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.concat(a, F.array(x))))


def keywords(c: Column) -> Column:
    """A comma-separated string as a tidy array."""
    return distinct_ignoring_case(F.split(c, ","))


def piece_text(c: Column) -> Column:
    """A subword piece without its markers, lowered."""
    return F.lower(F.regexp_replace(c, "Ġ|##", ""))


def compose(parts: list[Column], sep: str) -> Column:
    """Parts joined by ``sep``; empty parts are kept."""
    out = F.coalesce(parts[0], F.lit(""))
    for p in parts[1:]:
        out = F.concat(out, F.lit(sep), F.coalesce(p, F.lit("")))
    return out
