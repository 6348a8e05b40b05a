"""Benchmark decontamination by canonical templates.

A text becomes a sequence of template tokens.  Numbers (in digits or in words of a
table), names (capitalised words after another word or a comma, so not those that open
a sentence) and units (after a number, with or without white space) become typed
placeholders; other words are lowered.  Capitalised words elsewhere, which may be names
that open a sentence, are taken as words in one variant of a text and as names in
another, and a third variant takes no word as a name, so a copy in other cases (all in
capitals, say) still meets its text; windows are met in any variant, and of the second
and third only those that differ are looked at.  Items whose templates and slots are
alike in every variant are one class, looked for once under its smallest id.  Windows of ``k``
template tokens of documents are hash-joined with those of the benchmark, so a
question with other numbers or names still meets its template.  Where a document
covers enough of an item, its matches are grouped by occurrence: by where the item
would start (document position less item position), exactly, and in two rows of
steps as wide as the item has windows, one shifted by half a step, so that words put
in or left out don't part an occurrence and two versions are never in one step; and
all together, for items that are dispersed.  An occurrence must cover enough, or
``min_run`` windows of the item one after another without a word put in, and the
values in its slots must correspond one to one (the same benchmark value always has
the same document value and the reverse), or it is not the same question.  Numbers in
digits and in words are different values of one slot.  A
document is reported by its best occurrence if any passes.

The windows of all documents stream past a broadcast of the benchmark's windows
if its size allows, so documents are neither moved nor collected; a benchmark
beyond ``BROADCAST_BYTES`` is joined by a shuffle on the window's hash.  Slots
are read again only from documents that cover an item.

Defined results: null and empty texts have no windows.  An item shorter than
``k`` tokens is one window of its own length.  Windows with fewer than
``min_literals`` words that aren't placeholders are left out, since they fit
anything; an item without any other window is never found.  Repeated rows of an
id and text count as one document; other texts of an id, or of a null id, are looked
at on their own, and the id is reported by the best of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, stored, unsized

K = 8
MIN_LITERALS = 4
MIN_COVERAGE = 0.5
MIN_CONSISTENCY = 0.75
#: Windows one after another that are a finding whatever they cover of a long item.
MIN_RUN = 18
#: Units of measure and money.
UNITS = ["mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "min", "h", "hours", "minutes", "seconds", "days", "weeks", "months", "years", "meters", "metres", "miles", "feet", "inches", "dollars", "euros", "cents", "percent", "degrees", "pounds", "liters", "litres"]
NUMBER, NAME, UNIT, OPENER = "\u0001", "\u0002", "\u0003", "\u0004"
#: Numbers in words, by language (``one`` and its like where it isn't an article).
NUMBER_WORDS = {
    "en": "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split(),
    "de": "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend".split(),
    "fr": "zéro deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille".split(),
    "es": "cero dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil".split(),
}
DIGITS = "\\p{N}+(?:[.,]\\p{N}+)*"
WORD = "\\p{L}\\p{M}\\p{N}\u0001-\u0004"


def _once(df: DataFrame, keys: list[str], **columns: Column) -> DataFrame:
    """``keys`` and computed columns, each worked out once a row: behind a generator
    the optimizer doesn't copy an expression into a lambda that uses it."""
    return df.select(*keys, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words whatever their case, told apart by first letters.

    What can't begin one fails at its first letter; cases are spelt out, which is faster
    than a flag."""
    either = lambda c: f"[{c}{c.upper()}]" if len(c.upper()) == 1 and c.upper() != c else c
    spelt = lambda w: "".join(map(either, w))
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        heads.setdefault(w[0], []).append(w[1:])
    first = "".join(h + (h.upper() if len(h.upper()) == 1 else "") for h in heads)
    return f"(?=[{first}])(?<![{WORD}])(?:" + "|".join(f"{either(h)}(?:{'|'.join(map(spelt, rest))})" for h, rest in heads.items()) + ")"


def _marked(text: Column, values: bool, number_words: list[str]) -> Column:
    """The text, lowered, with a mark for each number, name and unit.  The name follows its
    mark, and with ``values`` numbers and units do, too, else they are left out.  Other
    capitalised words have a mark before them in any case.

    What stands before a match is looked at only where its first letter fits."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " ")
    letters = "[\\p{L}\\p{M}]"
    in_words = f"{NUMBER}{letters}+"
    if number_words:
        text = F.regexp_replace(text, f"{_any_of(number_words)}(?![{WORD}])", NUMBER + "$0")
        text = F.regexp_replace(text, f"[ -]{NUMBER}(?<={NUMBER}{letters}{{2,20}}[ -]{NUMBER})", "")  # forty-two is one number
        text = text if values else F.regexp_replace(text, in_words, NUMBER)
    text = F.regexp_replace(text, DIGITS, NUMBER + ("$0" if values else ""))
    number = f"(?:{NUMBER}{DIGITS}|{in_words})" if values else NUMBER
    text = F.regexp_replace(text, f"({number}) ?((?i:{'|'.join(UNITS)}))(?![{WORD}])", f"$1 {UNIT}{'$2' if values else ''}")
    text = F.regexp_replace(text, f"\\p{{Lu}}(?<=[\\p{{L}}\\p{{N}}{NUMBER}{UNIT},;:] .){letters}*", NAME + "$0")
    return F.lower(F.regexp_replace(text, f"\\p{{Lu}}(?<![\\p{{L}}\\p{{M}}\\p{{N}}{NUMBER}-{UNIT}].){letters}*", OPENER + "$0"))


#: The variants of a text: what becomes of the marks of names and of openers.
VARIANTS = [(NAME, ""), (NAME, NAME), ("", "")]


def _templates(df: DataFrame, keys: list[str], number_words: list[str]) -> DataFrame:
    """``keys`` and the hashes of the template tokens of ``text``: ``codes`` with openers as
    words, ``named`` with openers as names and ``flat`` without names (null if there is
    nothing that would differ)."""
    tokens = _once(df, keys, tokens=F.split(_marked(F.col("text"), False, number_words), f"[^{WORD}]+"))
    tokens = _once(tokens, keys, tokens=F.array_remove("tokens", ""))
    has = lambda mark: lambda x: F.startswith(x, F.lit(mark))
    bare = lambda x: F.translate(x, NAME + OPENER, "")
    as_name = F.xxhash64(F.lit(NAME))
    codes = F.transform("tokens", lambda x: F.when(has(NAME)(x), as_name).when(has(OPENER)(x), F.xxhash64(bare(x))).otherwise(F.xxhash64(x)))
    named = F.transform("tokens", lambda x: F.when(has(NAME)(x) | has(OPENER)(x), as_name).otherwise(F.xxhash64(x)))
    flat = F.transform("tokens", lambda x: F.when(has(NAME)(x) | has(OPENER)(x), F.xxhash64(bare(x))).otherwise(F.xxhash64(x)))
    return _once(tokens, keys, codes=codes, named=F.when(F.exists("tokens", has(OPENER)), named), flat=F.when(F.exists("tokens", has(NAME)), flat))


def _slotted(df: DataFrame, keys: list[str], number_words: list[str]) -> DataFrame:
    """``keys``, ``variant`` (see ``VARIANTS``), ``codes`` as before, ``slots`` (a token that
    holds a value, else an empty string), ``words`` (1 for a token without a value) and
    ``bare`` (tokens without marks), all equally long; a row for each variant of a text
    that differs from the first."""
    cut = f"(?:[^{WORD}.,]|[.,](?!\\p{{N}}))+"
    tokens = _once(df, keys, tokens=F.split(_marked(F.col("text"), True, number_words), cut))
    tokens = _once(tokens, keys, tokens=F.array_remove("tokens", ""))
    variant = lambda name, opener: F.transform("tokens", lambda x: F.replace(F.replace(x, F.lit(NAME), F.lit(name)), F.lit(OPENER), F.lit(opener)))
    there = [F.lit(True), *[F.contains(F.array_join("tokens", ""), F.lit(mark)) for mark in (OPENER, NAME)]]
    variants = [F.when(own, F.struct(F.lit(n).alias("variant"), variant(*v).alias("tokens"))) for n, (own, v) in enumerate(zip(there, VARIANTS))]
    tokens = tokens.select(*keys, F.inline(F.array_compact(F.array(*variants))))
    template = lambda x: F.regexp_replace(F.regexp_replace(x, f"{NUMBER}(?:{DIGITS}|[\\p{{L}}\\p{{M}}]+)", NUMBER), f"([{NAME}{UNIT}])[\\p{{L}}\\p{{M}}]+", "$1")
    held = lambda x: x.rlike(f"[{NUMBER}-{UNIT}]")
    return _once(
        tokens, [*keys, "variant"], codes=F.transform("tokens", lambda x: F.xxhash64(template(x))), slots=F.transform("tokens", lambda x: F.when(held(x), x).otherwise("")),
        words=F.transform("tokens", lambda x: F.when(held(x), 0).otherwise(1)), bare=F.transform("tokens", lambda x: F.translate(x, NUMBER + NAME + UNIT, "")),
    )


def _items(benchmark: DataFrame, item_col: str, item_text_col: str, number_words: dict[str, list[str]]) -> DataFrame:
    """The items' variants, with ``values`` for slots as they stand and for each slot in
    ``slots`` the place where its value comes first, which items of a class and all
    variants of an item share."""
    words = [w for own in number_words.values() for w in own]
    items = _slotted(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).distinct(), ["item_id"], words)
    place = F.transform("slots", lambda x, i: F.when(x == "", "").otherwise(F.array_position("bare", F.get("bare", i)).cast("string")))
    return items.select("item_id", "variant", "codes", F.col("slots").alias("values"), place.alias("slots"), "words")


def _classes(items: DataFrame) -> DataFrame:
    """``item_id, class_id``: items with the same templates, whose slots share values alike."""
    own = F.md5(F.concat_ws(",", F.col("variant").cast("string"), F.transform("codes", lambda x: x.cast("string")), F.lit("/"), "slots"))
    keyed = items.filter(F.col("variant") < 2).groupBy("item_id").agg(F.md5(F.array_join(F.array_sort(F.collect_set(own)), "/")).alias("key"))
    least = keyed.groupBy("key").agg(F.min("item_id").alias("class_id"))
    return keyed.join(least, "key").select("item_id", "class_id")


def item_classes(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", number_words: dict[str, list[str]] = NUMBER_WORDS) -> DataFrame:
    """``item_id, class_id`` of every benchmark item: the id under which ``leaks`` names it."""
    return _classes(_items(benchmark, item_col, item_text_col, number_words))


def _hashes(df: DataFrame, keys: list[str], codes: list[str], size: int) -> DataFrame:
    """``keys`` and, in place of each column of ``codes``, the hashes of all its windows of
    ``size`` codes, in order.

    A window's hash joins the hashes of two windows of half its size, so the work
    is a few passes over the codes whatever the size."""
    df, reach = df.select(*keys, *codes), 1
    while reach < size:
        step = min(reach, size - reach)
        joined = lambda c: F.transform(c, lambda x, i: F.xxhash64(x, F.get(c, i + step)))
        df = _once(df, keys, **{c: joined(c) for c in codes})
        reach += step
    return df.select(*keys, *[F.slice(c, F.lit(1), F.greatest(F.size(c) - (size - 1), F.lit(0))).alias(c) for c in codes])


def _detailed(df: DataFrame, keys: list[str], sizes: list[int], exact: bool) -> DataFrame:
    """``keys, size, pos, h, slots, words`` of every window; ``exact``: only of texts
    that are no longer than the window, unless it is the largest."""
    parts = []
    for size in sizes:
        own = df.filter((F.size("codes") == size) | F.lit(not exact or size == max(sizes)))
        windows = _hashes(own, [*keys, "slots", "words"], ["codes"], size).select(*keys, "slots", "words", F.posexplode("codes").alias("pos", "h"))
        parts.append(windows.select(*keys, F.lit(size).alias("size"), "pos", "h", F.slice("slots", F.col("pos") + 1, size).alias("slots"), F.slice("words", F.col("pos") + 1, size).alias("words")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _same(a: DataFrame, b: DataFrame, *columns: str) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & a[c].eqNullSafe(b[c])
    return on


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = K, min_literals: int = MIN_LITERALS, min_coverage: float = MIN_COVERAGE, min_consistency: float = MIN_CONSISTENCY, min_run: int = MIN_RUN, number_words: dict[str, list[str]] = NUMBER_WORDS) -> DataFrame:
    """A row for each document and class of items found in it: ``doc_id, item_id`` (the
    smallest of the class, see ``item_classes``), ``n_windows, item_windows, coverage,
    n_slots, changed_slots`` (other values than that item has) and ``consistency``."""
    words = [w for own in number_words.values() for w in own]
    docs = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text")).alias("doc_id"), F.col(text_col).alias("text"))
    items = stored(_items(benchmark, item_col, item_text_col, number_words))
    classes = _classes(items).withColumnRenamed("item_id", "member_id")
    # Names are words in the third variant, so each member has its own.
    items = items.join(classes, F.col("item_id").eqNullSafe(F.col("member_id"))).filter(F.col("item_id").eqNullSafe(F.col("class_id")) | (F.col("variant") == 2))
    items = stored(items.select(F.col("class_id").alias("item_id"), F.col("item_id").eqNullSafe(F.col("class_id")).alias("own"), "codes", "values", "slots", "words"))
    told = items.filter("own").select("item_id", F.explode(F.arrays_zip(F.col("slots").alias("b"), F.col("values").alias("value"))).alias("s")).select("item_id", "s.*").filter("b <> ''")
    told = told.groupBy("item_id", "b").agg(F.min("value").alias("value"))  # one value a slot
    sizes = [r[0] for r in items.select(F.least(F.size("codes"), F.lit(k)).alias("n")).filter("n > 0").distinct().sort("n").collect()] or [k]  # at most k
    literals = F.aggregate("words", F.lit(0), lambda a, x: a + x)
    of_items = stored(
        _detailed(items, ["item_id"], sizes, True).filter((literals >= F.least(F.lit(min_literals), F.col("size"))))
        .select("item_id", F.col("size").alias("b_size"), F.col("pos").alias("b_pos"), F.col("h").alias("b_h"), F.col("slots").alias("b_slots")).distinct()
    )
    totals = of_items.groupBy("item_id").agg(F.countDistinct("b_pos").alias("item_windows"), (F.max("b_pos") - F.min("b_pos") + 1).alias("width"))
    size_of = of_items.agg(F.sum(F.aggregate("b_slots", F.lit(80), lambda a, x: a + 16 + F.octet_length(x)))).first()[0] or 0
    side = F.broadcast if size_of <= BROADCAST_BYTES else unsized

    # 1. Which documents cover enough windows of an item?
    hashed, none = _templates(docs, ["doc_id"], words), F.array().cast("array<bigint>")
    for size in sizes:  # one pass over a text for all sizes of windows
        own = [c for c in hashed.columns if c.startswith("of_")]
        copy = {"c": F.col("codes"), "n": F.col("named"), "f": F.col("flat")}
        step = _hashes(hashed.withColumns(copy), ["doc_id", "codes", "named", "flat", *own], list(copy), size)
        other = [F.coalesce(F.filter(c, lambda x, i: x != F.get("c", i)), none) for c in ("n", "f")]
        hashed = step.select("doc_id", "codes", "named", "flat", *own, F.concat("c", *other).alias(f"of_{size}"))
    windows = hashed.select("doc_id", F.explode(F.concat(*[F.col(f"of_{size}") for size in sizes])).alias("h"))
    met = windows.join(side(of_items.select("item_id", "b_pos", "b_h").distinct()), F.col("h") == F.col("b_h")).select("doc_id", "item_id", "b_pos")
    covered = met.groupBy("doc_id", "item_id").agg(F.countDistinct("b_pos").alias("n_windows"))
    covered = stored(
        covered.join(totals, _same(covered, totals, "item_id")).select("doc_id", covered["item_id"], "item_windows", (F.col("n_windows") / F.col("item_windows")).alias("coverage"), "n_windows")
        .filter((F.col("coverage") >= min_coverage) | (F.col("n_windows") >= min_run))
    )

    # 2. Where the item has a value, what has the document?
    suspects = covered.select("doc_id").distinct()
    few = suspects.count() * 256 <= BROADCAST_BYTES
    texts = docs.join(F.broadcast(suspects) if few else unsized(suspects), _same(docs, suspects, "doc_id"), "left_semi")
    found = _detailed(_slotted(texts, ["doc_id"], words).drop("variant", "bare"), ["doc_id"], sizes, False).drop("words")
    found = found.withColumnRenamed("slots", "d_slots")
    hits = found.join(side(of_items), (F.col("h") == F.col("b_h")) & (F.col("size") == F.col("b_size")))
    values = F.filter(F.arrays_zip(F.col("b_slots").alias("b"), F.col("d_slots").alias("d")), lambda s: s["b"] != "")
    hits = hits.select("doc_id", "item_id", "b_pos", (F.col("pos") - F.col("b_pos")).alias("start"), values.alias("values"))
    wide = covered.join(totals, _same(covered, totals, "item_id")).select(covered["doc_id"], covered["item_id"], covered["item_windows"], totals["width"])
    hits = hits.join(unsized(wide), _same(hits, wide, "doc_id", "item_id")).select(hits["doc_id"], hits["item_id"], "item_windows", "width", "b_pos", "start", "values")
    step = lambda shift: F.floor((F.col("start") + shift) / F.col("width"))
    ways = [F.lit(0), F.col("start"), step(F.lit(0)), step(F.floor(F.col("width") / 2))]
    place = F.explode(F.array(*[F.struct(F.lit(n).alias("way"), at.cast("long").alias("at")) for n, at in enumerate(ways)]))
    hits = stored(hits.select("doc_id", "item_id", "item_windows", place.alias("place"), "b_pos", "values"))
    keys = ["doc_id", "item_id", "place"]
    covers = hits.groupBy(*keys, "item_windows").agg(F.array_sort(F.collect_set("b_pos")).alias("met"))
    # Sorted and distinct places: min_run of them in a row end min_run - 1 further on.
    streak = F.filter("met", lambda x, i: F.get("met", i + (min_run - 1)) == x + (min_run - 1))
    enough = (F.col("coverage") >= min_coverage) | ((F.col("place.way") == 1) & (F.size(streak) > 0))
    occurrences = covers.withColumn("n_windows", F.size("met").cast("long")).withColumn("coverage", F.col("n_windows") / F.col("item_windows")).filter(enough).drop("met")
    pairs = stored(hits.select(*keys, F.explode("values").alias("s")).select(*keys, "s.b", "s.d").distinct())
    one = pairs.groupBy(*keys, "b").agg(F.count("*").alias("n"), F.min("d").alias("d"))
    back = pairs.groupBy(*keys, "d").agg(F.count("*").alias("m"))
    slots = (
        one.join(unsized(back), _same(one, back, *keys, "d"), "left").join(side(told), _same(one, told, "item_id", "b"), "left")
        .select(*[one[c] for c in keys], ((F.col("n") == 1) & (F.col("m") == 1)).alias("fits"), (one["d"] != F.col("value")).alias("changed"))
        .groupBy(*keys).agg(F.count("*").alias("n_slots"), F.count_if("changed").alias("changed_slots"), F.count_if("fits").alias("fitting"))
    )
    out = occurrences.join(unsized(slots), _same(occurrences, slots, *keys), "left").select(
        *[occurrences[c] for c in keys], "n_windows", "item_windows", "coverage", F.coalesce("n_slots", F.lit(0)).alias("n_slots"),
        F.coalesce("changed_slots", F.lit(0)).alias("changed_slots"), F.coalesce(F.col("fitting") / F.col("n_slots"), F.lit(1.0)).alias("consistency"),
    ).filter(F.col("consistency") >= min_consistency)
    said = ["n_windows", "item_windows", "coverage", "n_slots", "changed_slots", "consistency"]
    rank = F.struct("n_windows", "consistency", -F.col("changed_slots"), -F.col("n_slots"))
    return out.groupBy(F.col("doc_id.id").alias("doc_id"), "item_id").agg(F.max_by(F.struct(*said), rank).alias("best")).select("doc_id", "item_id", "best.*")
