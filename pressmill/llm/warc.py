"""Derived WARC records: linked metadata and plain-text conversions of responses.

Each response gives two records.  Both name the response in WARC-Refers-To and
carry its target, date, headers and payload digest; each has its own id, block
and block digest.  Ids are name-based, so a rerun after a lost executor, or a
repeated row, gives the same records.

Everything is a projection of the response's own row: no shuffle, any size.  A page is
read by one pass over its characters, whatever is left open in it.

Defined results: a null payload is empty, a null target is an empty URI, null
headers are none; a repeated row gives its records again.  A script, style or comment
that isn't closed reaches to the end; a tag that isn't closed is dropped with what
follows; a ``<`` that begins no tag is text."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Elements that end a line of text; fixed by HTML's block-level elements.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split())
#: Elements whose content is no text.
SILENT = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in ("script", "style", "noscript")}
#: A tag up to its end; a ``<`` stops it, so each character is looked at a few times at most.
TAG = re.compile("""</?([a-zA-Z][^\\s/<>]*)((?:[^<>"']|"[^"<]*+"|'[^'<]*+')*+)>""")
NAME = re.compile("</?([a-zA-Z][^\\s/<>]*)")
ATTRIBUTE = re.compile("""([^\\s=>"'/]+)(?:\\s*=\\s*("[^"]*"|'[^']*'|[^\\s>]+))?""")
SPACE = re.compile("\\s+")
CHARSET = re.compile("charset\\s*=\\s*[\"']?([-\\w]+)", re.I)


def record_id(*parts: Column) -> Column:
    """``<urn:uuid:...>`` from the MD5 of the parts."""
    h = F.md5(F.concat_ws("\n", *parts))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])


def digest(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def _attributes(raw: str) -> dict[str, str]:
    """Attributes of a tag by lowered name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1 else value))
    return out


def read_page(page: str) -> dict:
    """``title``, ``language``, ``charset``, ``links`` and ``text`` (one line a block)."""
    said = {"title": "", "language": "", "charset": "", "links": []}
    out, at, pre, title = [], 0, 0, None
    while True:
        lt = page.find("<", at)
        piece = page[at:] if lt < 0 else page[at:lt]
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            out.append(piece if pre else SPACE.sub(" ", piece))
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            if end < 0:
                break
            at = end + 3
            continue
        whole = TAG.match(page, lt)
        named = whole or NAME.match(page, lt)
        if not named and page[lt + 1 : lt + 2] not in ("!", "?", "/"):
            out.append("<")
            at = lt + 1
            continue
        end = whole.end() if whole else page.find(">", lt) + 1
        if not end:
            break
        at = end
        if not named:
            continue
        name, closing = named[1].lower(), page[lt + 1] == "/"
        if name in SILENT and not closing:
            closed = SILENT[name].search(page, at)
            if not closed:
                break
            at = closed.start()
        elif name in BLOCKS:
            pre += (name == "pre") * (-1 if closing and pre else 0 if closing else 1)
            if name == "title" and title is None and not closing:
                title = len(out)
            elif name == "title" and title is not None and closing and not said["title"]:
                said["title"] = " ".join("".join(out[title:]).split())
            out.append("\n")
        elif not closing and name in ("a", "html", "meta"):
            own = _attributes(page[named.end(1) : end - 1])
            if name == "a" and own.get("href", "").strip():
                said["links"].append("".join(own["href"].split()))
            elif name == "html":
                said["language"] = said["language"] or own.get("lang", "").strip()
            elif name == "meta" and not said["charset"]:
                told = CHARSET.search(own.get("content", ""))
                said["charset"] = own.get("charset", "").strip() or (told[1] if told else "")
    lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
    return said | {"text": "\n".join(line for line in lines if line)}


def page_fields(payload: Column) -> Column:
    """A struct of what ``read_page`` finds."""

    @F.arrow_udf("struct<title string, language string, charset string, links array<string>, text string>")
    def read(pages: pa.Array) -> pa.Array:
        fields = [(k, pa.list_(pa.string()) if k == "links" else pa.string()) for k in ("title", "language", "charset", "links", "text")]
        return pa.array([read_page(p.as_py() or "") for p in pages], pa.struct(fields))

    return read(payload)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of fetched pages: ``page_id, record_id, target_uri, warc_date,
    headers`` (name and value pairs in order) ``, payload``."""
    payload, url = F.coalesce(F.col(html_col), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))
    header = lambda k, v: F.struct(F.lit(k).alias("name"), v.alias("value"))
    return pages.select(
        F.col(id_col).alias("page_id"), record_id(F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), url, F.sha2(payload, 256)).alias("record_id"), url.alias("target_uri"), F.lit(date).alias("warc_date"),
        F.array(header("Content-Type", F.lit("text/html; charset=utf-8")), header("Content-Length", F.octet_length(payload).cast("string"))).alias("headers"), payload.alias("payload"),
    )


def derive(source: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each row of ``responses``.

    Columns: ``page_id, record_id, warc_type, refers_to, target_uri, warc_date,
    content_type, content_length, source_headers, payload_digest, block_digest,
    block``."""
    payload = F.coalesce(F.col("payload"), F.lit(""))
    headers = F.coalesce(F.array_join(F.transform("headers", lambda h: F.concat(F.coalesce(h["name"], F.lit("")), F.lit(": "), F.coalesce(h["value"], F.lit("")), F.lit(CRLF))), ""), F.lit(""))
    field = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))
    links = F.array_join(F.transform("page.links", lambda x: field("outlink", x)), "")
    metadata = F.concat(
        field("title", F.col("page.title")), field("language", F.col("page.language")), field("charset", F.col("page.charset")),
        field("source-payload-digest", F.col("payload_digest")), F.regexp_replace(F.col("source_headers"), "(?m)^([^\\r\\n])", "source-header: $1"), links,
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), metadata.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("page.text").alias("block")),
    )
    return (
        source.select("page_id", F.coalesce("record_id", F.lit("")).alias("refers_to"), F.coalesce("target_uri", F.lit("")).alias("target_uri"), "warc_date", page_fields(payload).alias("page"), headers.alias("source_headers"), digest(payload).alias("payload_digest"))
        .withColumn("kind", F.explode(kinds))
        .select(
            "page_id", record_id(F.col("kind.warc_type"), F.col("refers_to"), F.sha2("kind.block", 256)).alias("record_id"), "kind.warc_type", "refers_to", "target_uri", "warc_date", "kind.content_type",
            F.octet_length("kind.block").cast("long").alias("content_length"), "source_headers", "payload_digest", digest(F.col("kind.block")).alias("block_digest"), "kind.block",
        )
    )


def serialised(records: DataFrame) -> DataFrame:
    """Each record as WARC text in ``value``, without the two line ends after it.

    What tells of the source has header fields of its own; the block is the record's
    whole payload, so its digest is the block digest."""
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))
    headers = F.regexp_replace("source_headers", "(?m)^([^\\r\\n])", "X-Source-Header: $1")
    return records.select(
        F.concat(
            F.lit("WARC/1.1" + CRLF), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")), line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.coalesce("warc_date", F.lit(""))),
            line("WARC-Block-Digest", F.col("block_digest")), line("X-Source-Payload-Digest", F.col("payload_digest")), headers, line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")), F.lit(CRLF), F.col("block"),
        ).alias("value")
    )


def write(records: DataFrame, path: str, compression: str = "none") -> None:
    """A WARC file a partition.  Uncompressed, a record can be read at its offset; with
    ``gzip`` a file is one stream, to be read from its start."""
    serialised(records).write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)
