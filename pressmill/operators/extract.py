"""Fields of archived pages.

One pass of an HTML parser emits candidates and the text of JSON-LD blocks; what these
blocks say, which candidate wins, and how lists are tidied, are ordinary column steps
(JSON-LD is a VARIANT).  A page that can't be parsed gives an error candidate and
doesn't fail the job."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, distinct_ignoring_case
from .markup import Walker, tidy
from .scratch import small_batches

#: Elements whose text isn't content, and attributes that mark content.
NOISE = {"script", "style", "noscript", "header", "footer", "nav", "aside"}
MAIN_TAGS = {"article", "main"}
MAIN_CLASSES = {"article", "entry-content", "post-content", "content"}
#: Field, and the meta names or properties that give it, in order of trust.
META = {
    "section": ["article:section", "article.section", "section", "sectionname"],
    "keywords": ["keywords", "news_keywords", "article:tag"],
    "description": ["description", "og:description", "twitter:description"],
    "author_name": ["author", "article:author", "parsely-author"],
    "published_date": ["article:published_time", "pubdate", "parsely-pub-date", "date", "publishdate"],
    "news_type": ["og:type", "article:content_tier", "parsely-type"],
}
#: Field, and the elements whose text gives it, in order of trust: an
#: attribute and its value (None: any) of the element, or of one around a link.
MARKED = {
    "section": [("data-testid", "rubric", False), ("data-vars-ga-category", None, False), ("class", "rubric", False), ("class", "section", False), ("class", "entry-section", False), ("class", "breadcrumbs", True), ("aria-label", "breadcrumb", True)],
    "keywords": [("rel", "tag", False), ("class", "tags", True), ("class", "tag-list", True), ("class", "topics", True), ("data-testid", "topic-link", False)],
    "author_name": [("rel", "author", False), ("itemprop", "author", False), ("class", "byline", True), ("class", "author", True), ("class", "author-name", False), ("class", "byline", False)],
    "author_description": [("class", "author-bio", False), ("class", "author__bio", False), ("class", "author-card__bio", False), ("class", "bio", False), ("data-testid", "author-bio", False)],
}
#: Ids of the archive's own toolbar, which isn't part of a page.
TOOLBAR = {"wm-ipp-base", "wm-ipp"}
SILENT = {"script", "style", "noscript"}
#: Types of JSON-LD objects that are articles.
ARTICLES = ["NewsArticle", "Article", "Report", "BlogPosting", "SatiricalArticle"]
LD_TYPE = "application/ld+json"
LIST_FIELDS = ["keywords", "author_name", "author_type", "author_description"]
#: Marked elements that are open at once, beyond which further ones aren't looked at.
MAX_MARKS = 64
_MARKS: dict[str, list[tuple[str, int, str | None, bool]]] = {}
for _field, _marks in MARKED.items():
    for _rank, (_name, _value, _inner) in enumerate(_marks):
        _MARKS.setdefault(_name, []).append((_field, _rank, _value, _inner))


class _Page(Walker):
    """Collects the title, metas, JSON-LD, times, headings, paragraphs and main blocks.

    Texts are kept once, in order; blocks and marked elements are ranges of them."""

    def __init__(self):
        super().__init__()
        self.seen: list[str] = []  # all but what scripts and styles hold
        self.content: list[str] = []  # without navigation and the like
        self.title: list[str] | None = None
        self.metas: list[tuple[str, str]] = []
        self.ld: list[list[str]] = []
        self.times: list[list] = []
        self.blocks: list[list[int]] = []
        self.paras: list[list[str]] = []
        self.heads: list[list[str]] = []
        self.marked: list[list] = []
        self.around: Counter = Counter()
        self.noise = self.toolbar = self.silent = self.in_ld = self.in_block = self.in_title = self.marks = 0
        self.undo: list[list] = []  # what closing each open element takes back

    def void(self, tag, attrs):
        if tag == "meta" and "content" in attrs:
            self.metas.append(((attrs.get("name") or attrs.get("property") or "").lower(), attrs["content"]))

    def _count(self, name: str, undo: list) -> None:
        setattr(self, name, getattr(self, name) + 1)
        undo.append(lambda: setattr(self, name, getattr(self, name) - 1))

    def opened(self, tag, attrs):
        undo: list = []
        self.undo.append(undo)
        ld = tag == "script" and attrs.get("type") == LD_TYPE
        if attrs.get("id") in TOOLBAR:
            self._count("toolbar", undo)
            self._count("noise", undo)
        if tag in NOISE and not ld:
            self._count("noise", undo)
        if tag in SILENT:
            self._count("silent", undo)
        if not self.toolbar:
            self._mark(tag, attrs, undo)
        if ld:
            self.ld.append([])
            self._count("in_ld", undo)
        if tag == "time" and not self.toolbar:
            own = [attrs.get("datetime", ""), len(self.seen), None]
            self.times.append(own)
            undo.append(lambda: own.__setitem__(2, len(self.seen)))
        if self.noise or ld:
            return
        if tag == "title" and self.title is None:
            self.title = []
            self._count("in_title", undo)
        if not self.in_block and (tag in MAIN_TAGS or attrs.get("role") == "main" or MAIN_CLASSES & set(attrs.get("class", "").split())):
            block = [len(self.content), None]  # the outermost is the longest
            self.blocks.append(block)
            self._count("in_block", undo)
            undo.append(lambda: block.__setitem__(1, len(self.content)))
        if tag == "p":
            self.paras.append([])
        if tag == "h1":
            self.heads.append([])

    def _mark(self, tag, attrs, undo):
        ranks: dict[str, int] = {}
        if tag == "a":
            for field, rank in self.around:
                ranks[field] = min(rank, ranks.get(field, rank))
        for name in attrs.keys() & _MARKS.keys():
            values = attrs[name].split()
            for field, rank, value, inner in _MARKS[name]:
                if value is None or value in values:
                    if inner:
                        self.around[field, rank] += 1
                        undo.append(lambda key=(field, rank): self._leave(key))
                    else:
                        ranks[field] = min(rank, ranks.get(field, rank))
        if self.marks < MAX_MARKS:
            for field in MARKED.keys() & ranks.keys():
                own = [field, ranks[field], len(self.seen), None]
                self.marked.append(own)
                self._count("marks", undo)
                undo.append(lambda own=own: own.__setitem__(3, len(self.seen)))

    def _leave(self, key) -> None:
        self.around[key] -= 1
        if not self.around[key]:
            del self.around[key]

    def closed(self, tag):
        for step in self.undo.pop():
            step()

    def text(self, data):
        if self.in_ld and self.stack[-1] == "script":
            self.ld[-1].append(data)
            return
        if not self.toolbar and not self.silent:
            self.seen.append(data)
        if self.noise:
            return
        if self.in_title:
            self.title.append(data)
            return
        if self.in_block:
            self.content.append(data)
        if self.open["p"] and self.paras:
            self.paras[-1].append(data)
        if self.open["h1"] and self.heads:
            self.heads[-1].append(data)


def parse(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def candidates_of(html: str | None) -> Iterator[tuple[str, int, int, str]]:
    """``field, rank, ordinal, value``: a lower rank is a more trusted source.

    Blocks of JSON-LD come as they are, as the field ``json_ld``."""
    page = parse(html)
    n = 0
    for raw in page.ld:
        if value := "".join(raw).strip():
            yield "json_ld", 0, (n := n + 1), value
    for name, content in page.metas:
        for field, names in META.items():
            if name in names:
                yield field, 1 + names.index(name), (n := n + 1), content
    for field, rank, start, end in page.marked:
        if text := tidy(page.seen[start:end]):
            yield field, 20 + rank, (n := n + 1), text
    for given, start, end in page.times:
        for value in (given, tidy(page.seen[start:end])):
            if value:
                yield "published_date", 10, (n := n + 1), value
    if page.title:
        yield "title", 0, (n := n + 1), tidy(page.title)
    for h in page.heads:
        yield "title", 1, (n := n + 1), tidy(h)


def _found(html: Column) -> Column:
    """The candidates of each page as an array."""

    @F.arrow_udf("array<struct<field: string, rank: int, ordinal: int, value: string>>")
    def read(pages: pa.Array) -> pa.Array:
        out = []
        for x in pages:
            try:
                own = list(candidates_of(x.as_py()))
            except Exception as e:  # one bad page must not fail the job
                own = [("parse_error", 0, 0, f"{type(e).__name__}: {e}")]
            out.append([dict(zip(("field", "rank", "ordinal", "value"), c)) for c in own])
        return pa.array(out, pa.list_(pa.struct([("field", pa.string()), ("rank", pa.int32()), ("ordinal", pa.int32()), ("value", pa.string())])))

    return read(html)


def unfolded(value: Column, rounds: int = 4) -> Column:
    """The objects in a VARIANT, in order: lists are opened, and what a ``@graph`` list
    holds comes before its object; to a depth of ``rounds``."""
    as_list = lambda v, path: F.try_variant_get(v, path, "array<variant>")
    step = lambda v, done: F.struct(v.alias("v"), F.lit(done).alias("done"))
    items = lambda found: F.transform(found, lambda v: step(v, False))

    def opened(x: Column) -> Column:
        graph = as_list(x["v"], '$["@graph"]')
        inner = F.when(graph.isNotNull(), F.concat(items(graph), F.array(step(x["v"], True)))).otherwise(F.array(step(x["v"], True)))
        return F.when(x["done"], F.array(x)).otherwise(F.coalesce(items(as_list(x["v"], "$")), inner))

    start = F.array(step(value, False))
    all_open = reduce(lambda found, _: F.flatten(F.transform(found, opened)), range(rounds), start)
    return F.transform(F.filter(all_open, lambda x: F.startswith(F.schema_of_variant(x["v"]), F.lit("OBJECT"))), lambda x: x["v"])


def _strings(value: Column, path: str) -> Column:
    """The texts at a path, be it one or a list of them."""
    one = F.try_variant_get(value, path, "string")
    return F.coalesce(F.try_variant_get(value, path, "array<string>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


def ld_types(value: Column) -> Column:
    found = _strings(value, '$["@type"]')
    return F.when(F.size(found) > 0, found).otherwise(_strings(value, "$.type"))


def primary_object(blocks: Column) -> Column:
    """Of blocks of JSON-LD (texts) the first object of an article type, else the first;
    blocks that aren't JSON are passed over."""
    objects = F.flatten(F.transform(F.filter(F.transform(blocks, lambda b: F.try_parse_json(b)), lambda v: v.isNotNull()), lambda v: unfolded(v)))
    article = F.filter(objects, lambda o: F.arrays_overlap(F.transform(ld_types(o), lambda t: F.trim(t)), F.array(*map(F.lit, ARTICLES))))
    return F.coalesce(F.get(article, F.lit(0)), F.get(objects, F.lit(0)))


def _of_object(o: Column) -> Column:
    """The candidates that a JSON-LD object gives, in order of trust."""
    authors = F.coalesce(F.try_variant_get(o, "$.author", "array<variant>"), F.array(F.try_variant_get(o, "$.author", "variant")))
    each = lambda f: F.flatten(F.transform(authors, f))
    named = lambda a: F.when(F.startswith(F.schema_of_variant(a), F.lit("OBJECT")), _strings(a, "$.name")).otherwise(_strings(a, "$"))
    found = [
        ("section", _strings(o, "$.articleSection")), ("keywords", _strings(o, "$.keywords")), ("description", _strings(o, "$.description")), ("published_date", F.concat(_strings(o, "$.datePublished"), _strings(o, "$.dateCreated"))),
        ("news_type", F.concat(ld_types(o), _strings(o, "$.additionalType"))), ("author_name", each(named)), ("author_type", each(ld_types)), ("author_description", each(lambda a: _strings(a, "$.description"))),
    ]
    values = F.flatten(F.array(*[_tagged(field, v) for field, v in found]))
    return F.transform(values, lambda x, i: F.struct(x["field"].alias("field"), F.lit(0).alias("rank"), i.alias("ordinal"), x["value"].alias("value")))


def _tagged(field: str, values: Column) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.struct(F.lit(field).alias("field"), x.alias("value")))


def with_candidates(pages: DataFrame, html_col: str = "html", out_col: str = "found") -> DataFrame:
    """``pages`` with an array of candidates of each, what JSON-LD says included."""
    read = pages.select("*", _found(F.col(html_col)).alias(out_col))
    is_ld = lambda x: x["field"] == "json_ld"
    blocks = F.transform(F.filter(out_col, is_ld), lambda x: x["value"])
    told = F.when(F.exists(out_col, is_ld), F.coalesce(_of_object(primary_object(blocks)), F.array().cast(read.schema[out_col].dataType)))
    return read.withColumn(out_col, F.coalesce(F.concat(told, F.filter(out_col, lambda x: ~is_ld(x))), F.col(out_col)))


def page_candidates(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, field, rank, ordinal, value`` of every candidate."""
    found = with_candidates(pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")))
    return found.select("page_id", F.inline("found"))


def text_of(html: str | None, max_chars: int = 4000) -> tuple[str | None, str | None, str | None]:
    """Title, meta description and main text of a page."""
    page = parse(html)
    blocks = [t for t in (tidy(page.content[start:end]) for start, end in page.blocks) if len(t) > 200]
    body = max(blocks, key=len) if blocks else " ".join([t for t in map(tidy, page.paras) if len(t) > 40][:20])
    described = next((tidy([c]) for n, c in page.metas if n == "description"), "")
    return (tidy(page.title) if page.title else None), described or None, body[:max_chars] or None


def page_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_chars: int = 4000) -> DataFrame:
    small_batches(pages.sparkSession)

    def run(batches):
        for pdf in batches:
            rows = []
            for page, html in zip(pdf["id"], pdf["html"]):
                try:
                    rows.append((page, *text_of(html, max_chars), None))
                except Exception as e:
                    rows.append((page, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["page_id", "title", "description", "article_text", "content_error"])

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInPandas(run, "page_id long, title string, description string, article_text string, content_error string")


def _poor(field: Column, value: Column, source: Column, avoid: dict[str, dict[str, list[str]]]) -> Column:
    """Does a value hold a name that its source's pages should be known by only for want
    of others? ``avoid``: field to source to names."""
    out = F.lit(False)
    for of, by in avoid.items():
        for who, names in by.items():
            for name in names:
                out = out | ((field == of) & (source == who) & F.contains(F.lower(value), F.lit(name.lower())))
    return F.coalesce(out, F.lit(False))


def field_choice(candidates: DataFrame, avoid: dict[str, list[str]] | None = None) -> DataFrame:
    """The first value that isn't blank per page and field, by rank, then ordinal.
    Values in ``avoid`` (a publisher's own name) are taken only for want of others."""
    poor = F.lit(False)
    for field, names in (avoid or {}).items():
        poor = poor | ((F.col("field") == field) & F.lower("value").isin([n.lower() for n in names]))
    some = candidates.withColumn("value", clean_text(F.col("value"))).filter("value IS NOT NULL")
    return some.groupBy("page_id", "field").agg(F.min_by("value", F.struct(poor, "rank", "ordinal")).alias("value"))


def list_fields(candidates: DataFrame, fields: list[str] = LIST_FIELDS) -> DataFrame:
    """All values of list fields in order, comma-separated ones split, without repeats
    (ignoring case, first spelling kept)."""
    each = candidates.filter(F.col("field").isin(fields)).select("page_id", "field", "rank", "ordinal", F.posexplode(F.when(F.col("field") == "keywords", F.split("value", ",")).otherwise(F.array("value"))).alias("pos", "v"))
    each = each.withColumn("v", clean_text(F.col("v"))).filter("v IS NOT NULL")
    first = each.groupBy("page_id", "field", F.lower("v").alias("low")).agg(F.min(F.struct("rank", "ordinal", "pos", "v")).alias("x"))
    return first.groupBy("page_id", "field").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("values"))


def page_metadata(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", source_col: str | None = None, avoid: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
    """One row a page with every field, lists, and ``parse_error``.

    With ``source_col``, values of a field that hold one of the names in
    ``avoid[field][source]`` count only if there is no other.  Repeated ids stay rows of
    their own; nothing is shuffled."""
    source = F.col(source_col) if source_col else F.lit(None).cast("string")
    found = with_candidates(pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"), source.alias("source"))).drop("html")
    tidy_one = lambda x: F.struct(_poor(x["field"], x["value"], F.col("source"), avoid or {}).alias("poor"), x["rank"].alias("rank"), x["ordinal"].alias("ordinal"), clean_text(x["value"]).alias("value"), x["field"].alias("field"))
    # Behind a generator the candidates are tidied once, not for each field.
    found = found.select("page_id", F.inline(F.array(F.struct(F.array_sort(F.filter(F.transform("found", tidy_one), lambda x: x["value"].isNotNull())).alias("c")))))
    values = lambda f: F.transform(F.filter("c", lambda x: x["field"] == f), lambda x: x["value"])
    single = [F.get(values(f), F.lit(0)).alias(f) for f in ("title", "section", "news_type", "description", "published_date", "parse_error")]
    split = lambda f: F.flatten(F.transform(values(f), lambda x: F.split(x, ","))) if f == "keywords" else values(f)
    lists = [F.when(F.size(values(f)) > 0, distinct_ignoring_case(split(f))).alias(f) for f in LIST_FIELDS]
    return found.select("page_id", *single, *lists)
