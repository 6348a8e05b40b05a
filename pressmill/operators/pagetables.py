"""Concept edges from the tables of pages.

Rows of the usual shape are read by patterns, natively; a page with any other markup of rows,
or with markup that hides some, goes whole to the parser.  For SQL there is a table function.
Which end of an edge counts, and which of several weights, are ordinary DataFrame steps."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .markup import Walker, tidy
from .scratch import small_batches

#: Class names of rows and cells, and of what is in the middle cell.
ROW, START, END, MIDDLE, LABEL, WEIGHT = "edge-main", "edge-start", "edge-end", "edge-rel", "rel-label", "weight"
TAGS = {"tr", "td", "a", "span", "div"}
ROWS = "start_path string, end_path string, label string, weight_text string"


class _Edges(Walker):
    """Collects the rows of edge tables: the first link of each end, the label and the weight."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[str, str, str | None, str | None]] = []
        self.row: dict[str, str] | None = None
        self.cell = ""
        self.part: tuple[str, int, list[str]] | None = None  # name, depth, texts
        self.depth = self.cell_depth = 0

    def opened(self, tag, attrs):
        if tag not in TAGS or self.row is None and tag != "tr":
            return
        classes = attrs.get("class", "").split()
        if tag == "tr" and ROW in classes:
            self.row, self.depth, self.cell, self.part = {}, len(self.stack), "", None
        elif self.row is None:
            return
        elif tag == "td" and (own := {START, END, MIDDLE} & set(classes)):
            name = min(own)
            # The first cell of a kind counts.
            self.cell = "" if name in self.row else name
            self.row.setdefault(name, "")
            self.cell_depth = len(self.stack)
        elif self.cell in (START, END) and tag == "a" and "href" in attrs:
            if not self.row[self.cell]:
                self.row[self.cell] = attrs["href"]
        elif self.cell == MIDDLE and self.part is None:
            name = LABEL if tag == "span" and LABEL in classes else WEIGHT if tag == "div" and WEIGHT in classes else ""
            if name and name not in self.row:
                self.part = (name, len(self.stack), [])

    def text(self, data):
        if self.part:
            self.part[2].append(data)

    def closed(self, tag):
        depth = len(self.stack)
        if self.part and self.part[1] == depth:
            self.row[self.part[0]] = tidy(["".join(self.part[2])])
            self.part = None
        if self.cell and self.cell_depth == depth:
            self.cell = ""
        if self.row is not None and self.depth == depth:
            if self.row.get(START) and self.row.get(END) and MIDDLE in self.row:
                self.rows.append((self.row[START], self.row[END], self.row.get(LABEL), self.row.get(WEIGHT)))
            self.row = None


#: Markup that needs no parser: tags with quoted values without references, and texts.
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][a-zA-Z-]*=(?:"[^"<>&]*"|'[^'<>&]*'))*)[ \t\n]*>|([^<]+)""")
_ATTR = re.compile(r"""([a-zA-Z][a-zA-Z-]*)=(?:"([^"]*)"|'([^']*)')""")
#: Elements whose content the parser reads in another way.
_OTHER = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext", "svg", "math"}


def _plain_rows(html: str) -> list[tuple[str, str, str | None, str | None]] | None:
    """The rows of a page of plain markup, as the parser gives them; None for other markup."""
    page, end, kinds = _Edges(), 0, {}
    start, close, text = page.handle_starttag, page.handle_endtag, page.text
    for m in _PLAIN.finditer(html):
        if m.start() != end:
            return None
        end = m.end()
        slash, tag, attrs, data = m.groups()
        if data is not None:
            if page.part:
                text(unescape(data) if "&" in data else data)
            continue
        low = kinds.get(tag)
        if low is None:
            low = kinds[tag] = tag.lower()
            if low in _OTHER:
                return None
        if slash:
            if attrs:
                return None
            close(low)
        else:
            start(low, [(k.lower(), a or b) for k, a, b in _ATTR.findall(attrs)] if attrs and low in TAGS else ())
    if end != len(html):
        return None
    while page.stack:
        close(page.stack[-1])
    return page.rows


def edges_of(html: str | None) -> Iterator[tuple[str, str, str | None, str | None]]:
    """The rows of a page's edge tables; what is left open at its end is closed."""
    if (rows := _plain_rows(html or "")) is not None:
        yield from rows
        return
    page = _Edges()
    page.feed(html or "")
    page.close()
    while page.stack:
        page.handle_endtag(page.stack[-1])
    yield from page.rows


def _row_pattern() -> tuple[str, str]:
    """A pattern for rows that parse in one way wherever they stand, and what is kept of them.

    All that such a row opens it closes itself, but for cells; repetitions are bounded, as
    the JVM's patterns recurse in them."""
    groups = 0

    def kept(*forms: str) -> tuple[str, str]:
        """Either of ``forms``, each with one group, and these groups."""
        nonlocal groups
        groups += len(forms)
        return f"(?:{'|'.join(forms)})", "".join(f"${n}" for n in range(groups - len(forms) + 1, groups + 1))

    quoted = lambda v: f"(?:'{v}'|\"{v}\")"
    said = "[^<&\\x01-\\x03]*"
    marked = f"{said}(?:(?:" + "|".join(f"<{t}>{said}</{t}>" for t in ("i", "b", "em", "strong")) + f"){said}){{0,4}}"
    extra = "(?: (?:class|title|rel|target)=(?:'[^'<>&]*'|\"[^\"<>&]*\")){0,3}"

    def end(name: str) -> tuple[str, str]:
        path, own = kept(*(f"{q}([^{q}<>&\\x01-\\x03]+){q}" for q in "'\""))
        link = f"<a{extra} href={path}{extra}>{marked}</a>"
        path, other = kept(*(f"{q}([^{q}<>&\\x01-\\x03]+){q}" for q in "'\""))
        inside = f"<span{extra}>{marked}<a{extra} href={path}{extra}>{marked}</a>{marked}</span>"
        return f"<td class={quoted(name)}>{marked}(?:{link}|{inside}){marked}(?:</td>)?{said}", own + other

    word = "[^<&\\p{Z}\\p{Cc}]+"  # no white space of any kind
    words = f"{word}(?: {word}){{0,8}}"
    start, first = end(START)
    labels = []
    for _ in range(2):
        form, own = kept(f"({words})", f"<b> *({words}) *</b>", f"<i> *({words}) *</i>")
        labels.append((f"<span class={quoted(LABEL)}> *{form} *</span>", own))
    form, weight = kept(f"({word})", f"<em> *({word}) *</em>", f"<b> *({word}) *</b>")
    middle = f"<td class={quoted(MIDDLE)}>{said}(?:<div(?: class={quoted('rel')})?>{said}(?:{labels[0][0]})?{said}</div>|{labels[1][0]})?{said}"
    middle += f"(?:<div class={quoted(WEIGHT)}> *(?:Weight:)? *{form} *</div>)?{said}(?:</td>)?{said}"
    last, second = end(END)
    main = quoted(f"{ROW}(?: [a-z0-9-]+){{0,4}}")
    return f"<tr class={main}>{said}{start}{middle}{last}</tr>", f"\x02{first}\x01{second}\x01{labels[0][1]}{labels[1][1]}\x01{weight}\x02"


#: Tags that hide nothing: with quoted values without references or rows, and not of ``_OTHER``.
_TAG = "</[a-z][a-z0-9]*>|<(?!(?:" + "|".join(sorted(_OTHER)) + """)[^a-z0-9])[a-z][a-z0-9]*(?:[ \\t\\n]+[a-zA-Z][a-zA-Z-]*=(?:"[^"<>&\\x02]*"|'[^'<>&\\x02]*')){0,20}[ \\t\\n]*>"""


def native_rows(pages: DataFrame, html_col: str = "html", out_col: str = "rows") -> DataFrame:
    """``pages`` with the rows of ``edges_of`` (a label or weight that lacks is empty), or null
    if the page needs the parser."""
    pattern, kept = _row_pattern()
    html = F.col(html_col)
    # What stands between rows and the rows take turns.
    read = pages.withColumn("_read", F.split(F.regexp_replace(html, F.lit(pattern), F.lit(kept)), "\x02"))
    read = read.withColumn("_rest", F.array_join(F.filter("_read", lambda x, i: i % 2 == 0), "\x02"))
    marks = F.contains(html, F.lit("\x01")) | F.contains(html, F.lit("\x02"))
    plain = ~F.regexp_replace("_rest", _TAG, "").rlike("[<&]") & ~F.contains("_rest", F.lit(ROW)) & ~marks
    parts = F.transform(F.filter("_read", lambda x, i: i % 2 == 1), lambda x: F.split(x, "\x01"))
    rows = F.transform(parts, lambda v: F.struct(*(F.get(v, F.lit(n)).alias(c.split()[0]) for n, c in enumerate(ROWS.split(", ")))))
    return read.withColumn(out_col, F.when(plain, rows)).drop("_read", "_rest")


def edge_rows(html: Column):
    """The table function of a page, for a lateral join; see ``page_edges``."""

    @udtf(returnType=ROWS)
    class EdgeRows:
        def eval(self, html: str):
            yield from edges_of(html)

    return EdgeRows(html)


def register(spark, name: str = "edge_rows") -> None:
    """For SQL: ``SELECT ... FROM pages, LATERAL edge_rows(html)``."""

    @udtf(returnType=ROWS)
    class EdgeRows:
        def eval(self, html: str):
            yield from edges_of(html)

    spark.udtf.register(name, EdgeRows)


def page_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the markup and with a row for each edge of their tables:
    ``start_path, end_path, rel`` (``RelatedTo`` without a label) and ``weight``.

    Rows without two linked ends or without a number for a weight are left out; a null or
    empty page has none."""
    made = {"start_path", "end_path", "rel", "weight", html_col.lower()}
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in made]  # columns of these names are replaced
    rows = native_rows(pages.select(F.struct(*kept, F.lit(0).alias("_")).alias("row"), F.coalesce(html_col, F.lit("")).alias("html")))

    @F.arrow_udf("array<struct<start_path: string, end_path: string, label: string, weight_text: string>>")
    def parsed(pages: pa.Array) -> pa.Array:
        names = [c.split()[0] for c in ROWS.split(", ")]
        return pa.array([[dict(zip(names, r)) for r in edges_of(h)] if h else None for h in pages.to_pylist()], pa.list_(pa.struct([(n, pa.string()) for n in names])))

    small_batches(pages.sparkSession)
    rows = rows.select("row", "rows", parsed(F.when(F.col("rows").isNull(), F.col("html"))).alias("parsed"))
    rows = rows.select("row", F.inline(F.coalesce("rows", "parsed")))
    path = lambda c: F.rtrim(c, F.lit("/"))
    weight = F.trim(F.regexp_replace("weight_text", "Weight:", "")).try_cast("double")
    own = [F.col(f"row.`{c}`") for c in pages.columns if c.lower() not in made]
    return rows.select(*own, path("start_path").alias("start_path"), path("end_path").alias("end_path"), F.coalesce(F.nullif("label", F.lit("")), F.lit("RelatedTo")).alias("rel"), weight.alias("weight")).filter("weight IS NOT NULL AND NOT isnan(weight)")


def concept_edges(edges: DataFrame, concept_col: str = "concept", lang: str = "en", min_weight: float = 1.0) -> DataFrame:
    """``concept, other, rel, weight``: edges of pages turned away from the concept that a
    page was asked for, the largest weight of each, over all pages of its tables.

    The other end is the one that begins a row, unless that is the concept itself; it must
    be a word of ``lang``."""
    own = F.concat(F.lit(f"/c/{lang}/"), F.col(concept_col))
    target = F.when(F.endswith("start_path", own), F.col("end_path")).otherwise(F.col("start_path"))
    e = edges.filter(F.col("weight") >= min_weight).select(F.col(concept_col).alias("concept"), target.alias("target"), "rel", "weight")
    e = e.filter(F.startswith("target", F.lit(f"/c/{lang}/"))).select("concept", F.get(F.split("target", "/"), F.lit(3)).alias("other"), "rel", "weight")
    return e.groupBy("concept", "other", "rel").agg(F.max("weight").alias("weight"))
