"""Queries over links, captures and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import enrich, extract, match, pagetables, scratch
from ..sources import capturelog, files
from ..streaming import jobs
from . import fixtures as fx
from .fixtures import with_views

FAMILY = ["example.com"]
ALIAS = "www.example.com"
#: The kinds of ids in article links: a long number at the end of a piece, a hex id, a number.
ID_TIERS = [urls.IdTier("digits", 9, 12, after="-", ends=True), urls.IdTier("hex", 24, 24), urls.IdTier("digits", 3, prefix="num:")]

# DuckDB forms of the URL functions.
_auth = lambda u: f"lower(regexp_extract(trim({u}), '^[a-zA-Z]+://([^/?#]*)', 1))"
_path = lambda u: f"regexp_extract(trim({u}), '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
_query = lambda u: f"regexp_extract(trim({u}), '\\?([^#]*)', 1)"
_host = lambda u: f"regexp_replace({_auth(u)}, '^www\\.', '')"
_q = lambda base, q: f"CASE WHEN {q} <> '' THEN {base} || '?' || {q} ELSE {base} END"
_canon = lambda u: f"CASE WHEN {_auth(u)} <> '' THEN " + _q(f"'https://' || {_auth(u)} || regexp_replace(CASE WHEN {_path(u)} = '' THEN '/' ELSE {_path(u)} END, '(.)/$', '\\1')", _query(u)) + " END"
_cpath = lambda u: f"regexp_replace(regexp_replace(regexp_replace('/' || {_path(u)}, '/+', '/', 'g'), '(.)/$', '\\1'), '/amp$', '')"
_clean = lambda u: f"CASE WHEN {_auth(u)} <> '' THEN 'https://' || {_host(u)} || {_cpath(u)} END"
_pairs = lambda u: f"array_to_string(list_transform(list_sort(list_transform(list_filter(string_split({_query(u)}, '&'), lambda p: p <> ''), lambda p: [url_decode(replace(split_part(p, '=', 1), '+', ' ')), url_decode(replace(CASE WHEN contains(p, '=') THEN regexp_replace(p, '^[^=]*=', '') ELSE '' END, '+', ' '))])), lambda p: p[1] || '=' || p[2]), '&')"
_exact = lambda u: f"CASE WHEN {_pairs(u)} <> '' THEN {_clean(u)} || '?' || {_pairs(u)} ELSE {_clean(u)} END"
_runs = lambda u: f"regexp_extract_all(regexp_replace(url_decode({u}), '[/?#]', ' ', 'g') || ' ', '[^0-9A-Za-z ]*[0-9A-Za-z]+ ?')"
_fits = lambda u, t: f"'{t.prefix}' || {'lower' if t.kind == 'hex' else ''}(regexp_extract(list_filter({_runs(u)}, lambda x: regexp_matches(x, '{t.pattern()}'))[1], '[0-9A-Za-z]+'))"
_id = lambda u: f"coalesce({', '.join(_fits(u, t) for t in ID_TIERS)})"
_quoted = lambda u: "replace(" * 7 + f"url_encode({u})" + "".join(f", '%{ord(c):02X}', '{c}')" for c in ":/?&=#%")
_latest = lambda key, src="capture_log": f"SELECT key, max(ts) AS ts, arg_max(url, struct_pack(a := ts, b := -event_id)) AS url, count(*) AS captures FROM (SELECT *, {key} AS key FROM {src}) WHERE key IS NOT NULL GROUP BY key"


def _scalar(name, spark_col, duck, view="links", col="article_link"):
    def run(spark, sf):
        return fx.links(spark, sf).select("page_id", spark_col(F.col(col)).alias(name))

    return run, with_views(f"SELECT page_id, {duck(col)} AS {name} FROM {view}", view)


def _cascade(spark, sf):
    L = F.col("article_link")
    return match.cascade_match(fx.links(spark, sf).select("article_link"), fx.capture_log(spark, sf), urls.exact_key(F.col("url")), urls.article_id(F.col("url"), ID_TIERS), urls.clean_key(F.col("url")), urls.exact_key(L), urls.article_id(urls.clean_key(L), ID_TIERS), urls.clean_key(L))


_CASCADE = f"""ke AS ({_latest(_exact('url'))}), ki AS ({_latest(_id('url'))}), kc AS ({_latest(_clean('url'))}),
l AS (SELECT DISTINCT article_link, {_exact('article_link')} AS l_exact, {_id(_clean('article_link'))} AS l_ident, {_clean('article_link')} AS l_clean FROM links),
m AS (SELECT l.*, ke.ts AS ts_exact, ki.ts AS ts_ident, kc.ts AS ts_clean,
    CASE WHEN l_clean IS NULL THEN 'invalid' WHEN ke.ts IS NOT NULL THEN 'exact' WHEN ki.ts IS NOT NULL THEN 'id' WHEN kc.ts IS NOT NULL THEN 'key' ELSE 'none' END AS matched_by
  FROM l LEFT JOIN ke ON l_exact = ke.key LEFT JOIN ki ON l_ident = ki.key LEFT JOIN kc ON l_clean = kc.key)
"""


def cascade_match(spark, sf):
    return _cascade(spark, sf).select("article_link", "matched_by", "ts", "wayback_url")


def match_funnel(spark, sf):
    return match.match_funnel(_cascade(spark, sf))


def latest_capture(spark, sf):
    return match.latest_capture(fx.capture_log(spark, sf), urls.canonical_key(F.col("url")))


def tiered_capture(spark, sf):
    return match.tiered_capture(fx.capture_log(spark, sf), urls.canonical_key(F.col("url")))


def variant_match(spark, sf):
    return match.variant_match(fx.links(spark, sf), fx.capture_log(spark, sf)).select("article_link", "key", "ts")


def tiered_variant_match(spark, sf):
    return match.tiered_variant_match(fx.links(spark, sf), fx.capture_log(spark, sf)).select("article_link", "key", "ts", "mimetype")


def _log_lines(spark, sf):
    """Lines with two to four fields, some with short or broken timestamps, some blank."""
    n = F.col("event_id")
    ts = F.when(n % 5 == 0, F.substring("ts", 1, 8)).when(n % 11 == 0, "bad").otherwise(F.col("ts"))
    rest = F.when(n % 3 == 0, "").when(n % 3 == 1, F.concat(F.lit("\t"), "status")).otherwise(F.concat(F.lit(" "), "status", F.lit("  "), "mimetype"))
    return fx.capture_log(spark, sf).select(F.when(n % 13 == 0, " \t ").otherwise(F.concat(F.lit(" "), ts, F.lit("  "), "url", rest)).alias("value"))


def capture_log_parse(spark, sf):
    return match.parse_capture_lines(_log_lines(spark, sf))


def capture_log_source(spark, sf):
    """The lines written as text files and read by byte ranges, through the data source."""
    at = scratch.folder(spark)
    _log_lines(spark, sf).write.text(at)
    capturelog.register(spark)
    return match.parse_capture_lines(spark.read.format("capture_log").option("splitBytes", 64 << 10).load(at))


def capture_line_counts(spark, sf):
    return match.capture_line_counts(_log_lines(spark, sf))


def stream_log_latest(spark, sf):
    """The latest capture per key, kept by a stream that follows log files; ties between
    lines go to the first place."""
    at = scratch.folder(spark)
    fx.capture_log(spark, sf).orderBy("event_id").select(F.concat_ws(" ", "ts", "url", "status", "mimetype").alias("value")).write.text(f"{at}/log")
    part = F.regexp_extract("path", "part-([0-9]+)[^/]*$", 1).cast("long")  # files are in order, too
    log = files.follow_capture_log(spark, f"{at}/log").withColumn("at", F.shiftleft(part, 40) + F.col("at"))
    jobs.latest_stream(spark, log, None, f"{at}/out", f"{at}/state", ordinal="at").awaitTermination()
    return jobs.read_latest(spark, f"{at}/out").select("key", "ts", "url")


def capture_window(spark, sf):
    return match.capture_window(fx.capture_log(spark, sf), "20240102000000", "20240120000000").select("event_id", "ts", "url")


def _dump(spark, sf):
    d = fx.links(spark, sf).filter("page_id % 2 = 0").select("page_id", "article_link", F.when(F.col("page_id") % 10 == 0, "").otherwise(F.concat(F.lit("c"), "page_id")).alias("wayback_url"))
    return d.union(d.select(F.col("page_id") + 1000000, "article_link", F.concat(F.lit("later"), "page_id")))


_DUMP = """dump0 AS (SELECT page_id, article_link, CASE WHEN page_id % 10 = 0 THEN '' ELSE 'c' || page_id END AS wayback_url FROM links WHERE page_id % 2 = 0),
dump AS (SELECT * FROM dump0 UNION ALL SELECT page_id + 1000000, article_link, 'later' || page_id FROM dump0)
"""


def first_wins_dedupe(spark, sf):
    return enrich.keyed_load(_dump(spark, sf), "article_link", "wayback_url", "page_id").select("article_link", "wayback_url")


def load_stats(spark, sf):
    return enrich.load_stats(_dump(spark, sf), "article_link", "wayback_url")


def tagged_union(spark, sf):
    p = fx.table(spark, sf, "pages").select("page_id", "url")
    return enrich.tagged_union({"even": p.filter("page_id % 2 = 0"), "odd": p.filter("page_id % 2 = 1")})


def latest_run(spark, sf):
    return files.latest_run(fx.predictions(spark, sf), "run").select("run", "model_path", "sample_id", "predicted_label")


def _state(spark, sf):
    return fx.table(spark, sf, "pages").filter("page_id % 3 <> 0").select("page_id", (F.col("page_id") % 4 == 1).alias("available"), F.when(F.col("page_id") % 5 == 0, "timeout").otherwise("").alias("error"))


_STATE = """st AS (SELECT page_id, page_id % 4 = 1 AS available, CASE WHEN page_id % 5 = 0 THEN 'timeout' ELSE '' END AS error FROM pages WHERE page_id % 3 <> 0)
"""


def todo_select(spark, sf):
    return enrich.todo(fx.links(spark, sf), _state(spark, sf), "page_id", True, False)


def resume_anti(spark, sf):
    return enrich.resume(fx.links(spark, sf), _state(spark, sf), fx.table(spark, sf, "pages").filter("page_id % 7 = 0").select("page_id"), "page_id")


def dead_letter(spark, sf):
    return enrich.dead_letters(_state(spark, sf).filter("error <> ''"), fx.table(spark, sf, "pages").filter("page_id % 2 = 0").select("page_id"), "page_id")


def error_log(spark, sf):
    """Errors of keys that were given up, as read back from the log and the dead letters."""
    at, failed = scratch.folder(spark), _state(spark, sf).filter("error <> ''")
    files.append_dead_letters(failed.withColumn("page_id", F.col("page_id").cast("string")), f"{at}/dead", "page_id")
    files.append_errors(failed, f"{at}/errors", "page_id")
    dead = spark.read.schema("page_id string").json(f"{at}/dead").select(F.col("page_id").cast("long").alias("page_id"))
    return spark.read.schema("page_id long, error string").json(f"{at}/errors").join(dead, "page_id", "left_semi")


def outcome_rollup(spark, sf):
    return _state(spark, sf).groupBy(enrich.outcome(F.col("available"), F.col("error")).alias("outcome")).agg(F.count("*").alias("n"))


def enriched(spark, sf):
    latest = match.latest_capture(fx.capture_log(spark, sf), urls.canonical_key(F.col("url"))).select("key", "ts", F.col("url").alias("capture"))
    p = fx.table(spark, sf, "pages")
    links = p.select("page_id", urls.canonical_key(F.col("url")).alias("key"))
    content = p.select(urls.canonical_key(F.col("url")).alias("key"), F.char_length("html").alias("html_chars")).groupBy("key").agg(F.max("html_chars").alias("html_chars"))
    return enrich.enrich(links, latest, content, "key").select("page_id", "key", "available", "ts", "capture", "html_chars")


def missing_links(spark, sf):
    return match.missing(fx.links(spark, sf), _dump(spark, sf).filter("wayback_url <> ''")).orderBy("article_link")


def merge_existing_wins(spark, sf):
    d = _dump(spark, sf)
    return enrich.merge_existing_wins(d.filter("page_id < 1000000"), d.filter("page_id >= 1000000"), "article_link", "wayback_url").orderBy("article_link")


def host_family(spark, sf):
    h = urls.host_no_www(F.col("article_link"))
    return fx.links(spark, sf).select("page_id", F.when(urls.in_family(h, FAMILY), "a").when(urls.in_family(h, ["example.net", "example.org"]), "b").alias("source"))


def host_histogram(spark, sf):
    return fx.links(spark, sf).groupBy(urls.host_no_www(F.col("article_link")).alias("host")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host")


def distinct_keys(spark, sf):
    return fx.capture_log(spark, sf).agg(F.count_distinct(urls.exact_key(F.col("url"))).alias("exact_keys"), F.count_distinct(urls.article_id(F.col("url"), ID_TIERS)).alias("ids"), F.count_distinct(urls.clean_key(F.col("url"))).alias("clean_keys"))


def distinct_links(spark, sf):
    return fx.capture_log(spark, sf).select("url").distinct()


def unmatched_examples(spark, sf):
    return match.missing(fx.links(spark, sf), _dump(spark, sf)).orderBy("article_link").limit(5)


def domain_check(spark, sf):
    """Up to 10 links outside the family; if there are none, a row that says so."""
    return match.host_check(fx.links(spark, sf), "article_link", ["example.com", "example.net"], 10)


def host_check_valid(spark, sf):
    return match.host_check(fx.links(spark, sf), "article_link", ["example.com", "example.net", "example.org"], 10)


def url_variants(spark, sf):
    return fx.links(spark, sf).select("page_id", F.array_join(urls.variants(F.col("article_link")), " ").alias("variants"))


def capture_url(spark, sf):
    link = F.concat("article_link", F.lit("?q=é|\"<x y>*+~%41#z"))
    made = urls.capture_url(F.lit("20240101000000"), link)
    return fx.links(spark, sf).select("page_id", made.alias("capture"), urls.capture_timestamp(made).alias("ts"))


def capture_variants(spark, sf):
    link = F.concat("article_link", F.when(F.col("page_id") % 2 == 0, ".html").otherwise(""))
    made = F.concat(F.lit("https://web.archive.org/web/20240101000000/"), link)
    return fx.links(spark, sf).select("page_id", F.array_join(urls.capture_variants(made, ALIAS, "www.example.net"), " ").alias("captures"))


def captures_per_day(spark, sf):
    return jobs.captures_per_day(fx.capture_log(spark, sf))


def stream_enrich(spark, sf):
    """Page metadata by a stream over the page files, until these are used up."""
    at, pages = scratch.folder(spark), f"{sf}/pages.parque[t]"  # a glob may be a file or a folder
    jobs.enrich_stream(spark, pages, "page_id long, url string, html string", f"{at}/out", f"{at}/state", progress=f"{at}/progress").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("page_id", "title", "section", "description", "keywords", "parse_error")


def stream_progress(spark, sf):
    """Rows read, kept and failed of that stream, counted as they are written."""
    at, pages = scratch.folder(spark), f"{sf}/pages.parque[t]"
    jobs.enrich_stream(spark, pages, "page_id long, url string, html string", f"{at}/out", f"{at}/state", progress=f"{at}/progress").awaitTermination()
    return jobs.read_progress(spark, f"{at}/progress").agg(*[F.sum(c).alias(c) for c in ("rows", "kept", "failed")])


def stream_latest(spark, sf):
    """The latest capture per key, kept by a stream; equal to ``latest_capture``."""
    at = scratch.folder(spark)
    fx.capture_log(spark, sf).select("event_id", "ts", "url").write.parquet(f"{at}/log")
    jobs.latest_stream(spark, f"{at}/log", "event_id long, ts string, url string", f"{at}/out", f"{at}/state").awaitTermination()
    return jobs.read_latest(spark, f"{at}/out").select("key", "ts", "url")


def stream_per_day(spark, sf):
    """Captures per host and day, counted by a stream; equal to ``captures_per_day``."""
    at = scratch.folder(spark)
    fx.capture_log(spark, sf).write.parquet(f"{at}/log")
    jobs.per_day_stream(spark, f"{at}/log", "event_id long, ts string, status string, mimetype string, url string", f"{at}/out", f"{at}/state").awaitTermination()
    return jobs.read_days(spark, f"{at}/out")


def jsonl_scan(spark, sf):
    """Documents as JSON lines, some of them broken or without a key, read back and counted."""
    at, n = scratch.folder(spark), F.col("doc_id")
    line = F.when(n % 11 == 0, "{broken").when(n % 13 == 0, F.to_json(F.struct("lang"))).otherwise(F.to_json(F.struct("doc_id", "lang")))
    fx.table(spark, sf, "documents").select(line.alias("value")).write.text(at)
    return files.jsonl_stats(spark, at, "doc_id long, lang string", "doc_id")


def json_array_scan(spark, sf):
    """Pages as JSON arrays, one a file, and as JSON lines, read by the same function."""
    at = scratch.folder(spark)
    pages = fx.table(spark, sf, "pages").select("page_id", "url")
    files.write_json_arrays(pages, f"{at}/array", F.floor(F.col("page_id") / 1000))
    files.append_jsonl(pages, f"{at}/lines")
    both = [files.read_json_auto(spark, f"{at}/{kind}", "page_id long, url string").select("page_id", "url", F.lit(kind).alias("kind")) for kind in ("array", "lines")]
    return both[0].union(both[1])


def csv_round_trip(spark, sf):
    """Texts with quotes and line ends through a CSV file with fixed columns."""
    at = scratch.folder(spark)
    files.write_csv(fx.table(spark, sf, "documents").filter("text <> ''"), at, ["doc_id", "lang", "text"])
    return files.read_csv(spark, at, "doc_id long, lang string, text string").select("doc_id", "lang", F.md5("text").alias("text_md5"))


def key_sketches(spark, sf):
    """Distinct keys by day from sketches that are kept: is the merged estimate that of the
    whole, and within 2 % of the exact count?"""
    log = fx.capture_log(spark, sf)
    keys = {"exact": urls.exact_key(F.col("url")), "clean": urls.clean_key(F.col("url")), "events": F.col("event_id").cast("string")}
    days = scratch.stored(match.key_sketches(log, F.substring("ts", 1, 8), keys))
    merged, whole = match.sketch_counts(days, list(keys)), match.sketch_counts(match.key_sketches(log, F.lit(""), keys), list(keys))
    exact = log.agg(*[F.count_distinct(c).alias(n) for n, c in keys.items()])
    row = lambda df, name: df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias(name)) for k in keys])))
    out = row(merged, "merged").join(row(whole, "whole"), "key").join(row(exact, "n"), "key")
    near = lambda c: F.abs(F.col(c) - F.col("n")) <= 0.02 * F.col("n")
    return out.select("key", "n", (near("merged") & near("whole")).alias("near"), (F.abs(F.col("merged") - F.col("whole")) <= 0.01 * F.col("n")).alias("merged_as_whole"))


def commit_rewrites(spark, sf):
    """A list of links that is rewritten as a whole, twice; the last one counts."""
    at, pages = scratch.folder(spark), fx.links(spark, sf)
    files.commit_json(pages, at)
    files.commit_json(files.read_committed(spark, at, "page_id long, article_link string").filter("page_id % 3 > 0"), at)
    return files.read_committed(spark, at, "page_id long, article_link string")


def latest_complete_run(spark, sf):
    """The newest of three run folders that has its results; a later one lacks them."""
    at = scratch.folder(spark)
    for n, required in ((1, True), (2, True), (3, False)):
        files.write_csv(fx.predictions(spark, sf).filter(F.col("sample_id") % 3 >= 3 - n), f"{at}/2024-01-0{n}", ["run", "model_path", "sample_id", "predicted_label"])
        if not required:
            files._delete(spark, f"{at}/2024-01-0{n}/_SUCCESS")
    rows = files.read_latest_run(spark, at, "_SUCCESS", "run_kind string, model_path string, sample_id long, predicted_label int")
    return rows.select("run", "run_kind", "model_path", "sample_id", "predicted_label")


def _edge_pages(spark, sf):
    """Pages of concepts: a table row for each two neighbouring words of a page's text, with
    nested markup, links to words of two languages, and labels and weights that may lack."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace("html", "<[^>]*>", " ")), F.lit(text.TOKEN), 0)
    # Spread while they are small: the tables are many times the size of their pages.
    pages = fx.table(spark, sf, "pages").select("page_id", "html").repartition(8 * spark.sparkContext.defaultParallelism, "page_id")
    t = pages.select("page_id", words.alias("w")).select("page_id", F.get("w", F.lit(0)).alias("concept"), F.arrays_zip(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))).alias("b")).alias("p"))
    said = lambda x: F.concat(F.lit("<span class='rel-label'><b>R"), F.substring(F.md5(F.concat(x["a"], F.lit(":"), x["b"])), 1, 1), F.lit("</b> </span>"))
    row = lambda x, i: F.concat(
        F.lit("<tr class='edge-main odd'><td class='edge-start'><span class='term'><a href='/c/en/"), x["a"], F.lit("'><i>"), x["a"], F.lit("</i></a></span><td class='edge-rel'><div>"), F.when(i % 7 == 0, "").otherwise(said(x)),
        F.lit("</div>"), F.when(i % 11 == 0, "").otherwise(F.concat(F.lit("<div class='weight'>Weight: <em>"), (i * 37 % 400 / 100).cast("string"), F.lit("</em></div>"))), F.lit("</td><td class='edge-end'><a href='/c/"), F.when(i % 5 == 0, "fr").otherwise("en"), F.lit("/"), x["b"], F.lit("/n/'>"), x["b"], F.lit("</a></td></tr>"),
    )
    table = F.concat(F.lit("<div><table><tr><th>Start<th>Relation<th>End</tr>"), F.array_join(F.transform("p", row), "\n"), F.lit("</table></div>"))
    return t.filter("concept IS NOT NULL").select("page_id", "concept", table.alias("html"))


def page_edges(spark, sf):
    """Edges of the tables of concept pages, by page."""
    return pagetables.page_edges(_edge_pages(spark, sf).drop("concept"))


def page_concept_edges(spark, sf):
    """The same turned away from each page's concept, the largest weight of each."""
    return pagetables.concept_edges(pagetables.page_edges(_edge_pages(spark, sf)))


def json_ld_fields(spark, sf):
    """Fields of pages whose JSON-LD has a primary article behind, inside or beside others."""
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    json = F.to_json(F.struct(title.alias("t")))
    said = F.substring(json, F.lit(7), F.char_length(json) - 8)  # the title as JSON has it
    block = lambda *parts: F.concat(F.lit('<script type="application/ld+json">'), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("</script>"))
    report = block('{"@type": ["Report", "Extra"], "articleSection": ["  ", " S ', said, '\\n"], "keywords": "k1, K1,k2", "author": [{"@type": "Person", "name": "', said, '"}, "Bob"]}')
    graph = block('{"@context": "x", "@graph": [{"@type": "Organization", "description": "org"}, [{"@type": "BlogPosting", "description": "D ', said, '", "datePublished": "2020-01-01"}], {"@type": "WebPage"}]}')
    kind = F.col("page_id") % 4
    ld = F.when(kind == 1, F.concat(block('{"@type": "WebPage", "articleSection": "web"}'), report)).when(kind == 2, graph).when(kind == 3, F.concat(block('{"broken": '), block('["text", 5, {"type": "Thing", "articleSection": "T", "dateCreated": "2021"}, {"@type": "Other"}]'))).otherwise("")
    pages = fx.table(spark, sf, "pages").select("page_id", F.concat(ld, "html").alias("html"))
    m = extract.page_metadata(pages)
    return m.select("page_id", "section", "news_type", "description", "published_date", *[F.array_join(c, ";").alias(c) for c in ("keywords", "author_name", "author_type")])


def page_title(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))


def _candidates(pages):
    one = lambda f, r, o, p: F.struct(F.lit(f).alias("field"), F.lit(r).alias("rank"), F.lit(o).alias("ordinal"), F.regexp_extract("html", p, 1).alias("value"))
    title, head, nav = one("title", 0, 0, "<title>(.*?)</title>"), one("title", 1, 1, "<h1>(.*?)</h1>"), one("nav", 0, 2, "<a [^>]*>(.*?)</a>")
    return pages.select("page_id", F.explode(F.array(title, head, nav)).alias("c")).select("page_id", "c.*")


def field_choice(spark, sf):
    return extract.field_choice(_candidates(fx.table(spark, sf, "pages")))


def page_candidates(spark, sf):
    return extract.page_candidates(fx.table(spark, sf, "pages"))


def page_text(spark, sf):
    return extract.page_text(fx.table(spark, sf, "pages"))


def page_metadata(spark, sf):
    return extract.page_metadata(fx.table(spark, sf, "pages"))


def dedupe_keep_order(spark, sf):
    links = F.regexp_extract_all("html", F.lit("<a [^>]*>(.*?)</a>"), 1)
    return fx.table(spark, sf, "pages").select("page_id", F.array_join(text.distinct_ignoring_case(links), "|").alias("nav"))


_vq = lambda s, h, p, q: _q(f"'{s}://' || {h} || {p}", q)
_p0 = f"CASE WHEN {_path('article_link')} = '' THEN '/' ELSE {_path('article_link')} END"
_VARIANTS = f"""v0 AS (SELECT page_id, article_link, {_auth('article_link')} AS h, {_p0} AS p, {_query('article_link')} AS q FROM links),
v1 AS (SELECT *, CASE WHEN p = '/' THEN '/' WHEN ends_with(p, '/') THEN regexp_replace(p, '/$', '') ELSE p || '/' END AS p2, CASE WHEN starts_with(h, 'www.') THEN substr(h, 5) ELSE 'www.' || h END AS h2 FROM v0),
v2 AS (SELECT page_id, article_link, [article_link, {', '.join(_vq(s, h, p, q) for q in ('q', "''") for s in ('https', 'http') for p in ('p', 'p2') for h in ('h', 'h2'))}] AS v FROM v1),
v3 AS (SELECT page_id, article_link, unnest(v) AS x, unnest(range(len(v))) AS i FROM v2),
v4 AS (SELECT page_id, article_link, x, min(i) AS i FROM v3 GROUP BY ALL)
"""

_PAIRS = {
    "url_host": _scalar("host", urls.host_no_www, _host),
    "url_canonical": _scalar("key", urls.canonical_key, _canon),
    "url_clean": _scalar("key", urls.clean_key, _clean),
    "url_exact": _scalar("key", urls.exact_key, _exact),
    "url_decode3": _scalar("decoded", lambda c: urls.decode_repeatedly(F.replace(c, F.lit("/en"), F.lit("%252Fen"))), lambda c: f"url_decode(url_decode(url_decode(replace({c}, '/en', '%252Fen'))))"),
    "url_id": _scalar("id", lambda c: urls.article_id(c, ID_TIERS), _id),
    "url_repair": _scalar("url", lambda c: urls.repaired(F.concat(F.lit("https://www.example.com"), c), ALIAS), lambda c: f"regexp_replace('https://www.example.com' || {c}, '^https?://www[.]example[.]com(https?://)', '\\1')"),
}
QUERIES = {k: v[0] for k, v in _PAIRS.items()} | {f.__name__: f for f in (cascade_match, match_funnel, latest_capture, tiered_capture, variant_match, capture_log_parse, capture_log_source, capture_line_counts, stream_log_latest, stream_progress, capture_window, first_wins_dedupe, load_stats, tagged_union, latest_run, todo_select, resume_anti, dead_letter, outcome_rollup, missing_links, merge_existing_wins, host_family, host_histogram, distinct_keys, distinct_links, unmatched_examples, domain_check, url_variants, capture_url, captures_per_day, stream_enrich, stream_latest, stream_per_day, jsonl_scan, json_array_scan, csv_round_trip, key_sketches, commit_rewrites, latest_complete_run, page_edges, page_concept_edges, json_ld_fields, host_check_valid, page_title, field_choice, page_candidates, page_text, page_metadata, dedupe_keep_order, tiered_variant_match, error_log, capture_variants)} | {"enrich": enriched}

_H = _host("article_link")
_fam = lambda *ds: "(" + " OR ".join(f"{_H} = '{d}' OR ends_with({_H}, '.{d}')" for d in ds) + ")"
_PER_DAY = f"SELECT {_host('url')} AS host, substr(ts, 1, 8) AS day, count(*) AS read, count(*) FILTER (status = '200' AND mimetype = 'text/html') AS kept FROM capture_log GROUP BY ALL"
_TIERED = f"SELECT key, arg_max(ts, struct_pack(a := mimetype = 'text/html', b := ts, c := mimetype)) AS ts, arg_max(mimetype, struct_pack(a := mimetype = 'text/html', b := ts, c := mimetype)) AS mimetype FROM (SELECT *, {_canon('url')} AS key FROM capture_log WHERE status = '200') WHERE key IS NOT NULL GROUP BY key"
_CHECK = "bad AS (SELECT DISTINCT article_link FROM links WHERE NOT {}) SELECT * FROM (SELECT article_link, false AS all_valid FROM bad ORDER BY 1 LIMIT 10) UNION ALL SELECT NULL, true WHERE NOT EXISTS (SELECT 1 FROM bad)"
_LOG_FIELDS = """SELECT rpad(CASE WHEN event_id % 5 = 0 THEN substr(ts, 1, 8) ELSE ts END, 14, '0') AS ts, url,
  CASE WHEN event_id % 3 = 0 THEN '200' ELSE status END AS status, CASE WHEN event_id % 3 = 2 THEN mimetype ELSE 'text/html' END AS mimetype
FROM capture_log WHERE event_id % 13 <> 0 AND (event_id % 5 = 0 OR event_id % 11 <> 0)"""
_EDGE_PAGES = '''WITH t AS (SELECT page_id, regexp_extract_all(lower(regexp_replace(html, '<[^>]*>', ' ', 'g')), '[\\p{L}\\p{N}_]{2,}') AS w FROM pages),
p AS (SELECT page_id, w[1] AS concept, w, unnest(range(0, len(w) - 1)) AS i FROM t),
x AS (SELECT page_id, concept, i, w[i + 1] AS a, w[i + 2] AS b FROM p),
e AS (SELECT *, CASE WHEN i % 5 = 0 THEN '/c/fr/' ELSE '/c/en/' END AS lang, CASE WHEN i % 7 = 0 THEN 'RelatedTo' ELSE 'R' || substr(md5(a || ':' || b), 1, 1) END AS rel, i * 37 % 400 / 100::DOUBLE AS weight FROM x)
'''
ORACLE = {k: v[1] for k, v in _PAIRS.items()} | {
    "cascade_match": with_views(_CASCADE + "SELECT article_link, matched_by, CASE WHEN l_clean IS NOT NULL THEN coalesce(ts_exact, ts_ident, ts_clean) END AS ts, 'https://web.archive.org/web/' || coalesce(ts_exact, ts_ident, ts_clean) || '/' || l_clean AS wayback_url FROM m", "capture_log", "links"),
    "match_funnel": with_views(_CASCADE + """SELECT count(*) AS links, count(*) FILTER (l_clean IS NULL) AS invalid_clean, count(*) FILTER (matched_by = 'exact') AS matched_by_exact, count(*) FILTER (matched_by = 'id') AS matched_by_id,
  count(*) FILTER (matched_by = 'key') AS matched_by_key, count(*) FILTER (l_clean IS NOT NULL AND ts_exact IS NULL) AS exact_not_found, count(*) FILTER (l_clean IS NOT NULL AND ts_exact IS NULL AND l_ident IS NULL) AS no_id,
  count(*) FILTER (l_clean IS NOT NULL AND ts_exact IS NULL AND l_ident IS NOT NULL AND ts_ident IS NULL) AS id_not_found, count(*) FILTER (l_clean IS NOT NULL AND ts_exact IS NULL AND ts_ident IS NULL AND ts_clean IS NULL) AS key_not_found, count(*) FILTER (matched_by = 'none') AS unmatched FROM m""", "capture_log", "links"),
    "latest_capture": with_views(_latest(_canon("url")), "capture_log"),
    "stream_latest": with_views(f"SELECT key, ts, url FROM ({_latest(_canon('url'))})", "capture_log"),
    "tiered_capture": with_views(_TIERED, "capture_log"),
    "tiered_variant_match": with_views(_VARIANTS + f""", idx AS ({_TIERED}),
v5 AS (SELECT article_link, {_canon('x')} AS key, min(i) AS pos FROM v4 GROUP BY ALL),
hit AS (SELECT article_link, arg_min(idx.key, pos) AS key, arg_min(ts, pos) AS ts, arg_min(mimetype, pos) AS mimetype FROM v5 JOIN idx ON idx.key = v5.key GROUP BY article_link)
SELECT l.article_link, hit.key, hit.ts, hit.mimetype FROM (SELECT DISTINCT article_link FROM links) l LEFT JOIN hit ON hit.article_link = l.article_link""", "capture_log", "links"),
    "error_log": "WITH " + _STATE + "SELECT page_id, error FROM st WHERE error <> ''",
    "capture_variants": with_views("""c0 AS (SELECT page_id, 'https://web.archive.org/web/20240101000000/' AS p, article_link || CASE WHEN page_id % 2 = 0 THEN '.html' ELSE '' END AS l FROM links),
c1 AS (SELECT page_id, p, l, regexp_replace(l, '^(https?://)www[.]example[.]com([/?#]|$)', '\\1www.example.net\\2') AS m FROM c0),
c2 AS (SELECT page_id, [p || l, p || m, p || regexp_replace(l, '^([^?#]*)[.]html([?#]|$)', '\\1\\2'), p || regexp_replace(m, '^([^?#]*)[.]html([?#]|$)', '\\1\\2')] AS v FROM c1)
SELECT page_id, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), ' ') AS captures FROM c2""", "links"),
    "variant_match": with_views(_VARIANTS + f""", idx AS ({_latest(_canon('url'))}),
v5 AS (SELECT article_link, {_canon('x')} AS key, min(i) AS pos FROM v4 GROUP BY ALL),
hit AS (SELECT article_link, arg_min(idx.key, pos) AS key, arg_min(ts, pos) AS ts FROM v5 JOIN idx ON idx.key = v5.key GROUP BY article_link)
SELECT l.article_link, hit.key, hit.ts FROM (SELECT DISTINCT article_link FROM links) l LEFT JOIN hit ON hit.article_link = l.article_link""", "capture_log", "links"),
    "capture_log_parse": with_views(_LOG_FIELDS, "capture_log"),
    "capture_log_source": with_views(_LOG_FIELDS, "capture_log"),
    "capture_line_counts": with_views("SELECT count(*) FILTER (event_id % 13 <> 0 AND (event_id % 5 = 0 OR event_id % 11 <> 0)) AS captures, count(*) FILTER (event_id % 13 <> 0 AND event_id % 5 <> 0 AND event_id % 11 = 0) AS rejected, count(*) FILTER (event_id % 13 = 0) AS blank FROM capture_log", "capture_log"),
    "stream_log_latest": with_views(f"SELECT key, ts, url FROM ({_latest(_canon('url'))})", "capture_log"),
    "stream_progress": 'SELECT count(*) AS "rows", count(*) AS kept, 0 AS failed FROM (SELECT DISTINCT page_id FROM pages)',
    "capture_window": with_views("SELECT event_id, ts, url FROM capture_log WHERE status = '200' AND mimetype = 'text/html' AND ts BETWEEN '20240102000000' AND '20240120000000'", "capture_log"),
    "first_wins_dedupe": with_views(_DUMP + "SELECT article_link, arg_min(wayback_url, page_id) AS wayback_url FROM dump WHERE trim(article_link) <> '' AND trim(wayback_url) <> '' GROUP BY article_link", "links"),
    "load_stats": with_views(_DUMP + "SELECT count(DISTINCT CASE WHEN trim(wayback_url) <> '' THEN article_link END) AS kept, count(*) FILTER (trim(wayback_url) = '') AS invalid, count(*) FILTER (trim(wayback_url) <> '') - count(DISTINCT CASE WHEN trim(wayback_url) <> '' THEN article_link END) AS duplicates FROM dump", "links"),
    "tagged_union": "SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN 'even' ELSE 'odd' END AS origin FROM pages",
    "latest_run": with_views("SELECT run, model_path, sample_id, predicted_label FROM predictions WHERE run = (SELECT max(run) FROM predictions)", "predictions"),
    "todo_select": with_views(_STATE + "SELECT l.* FROM links l LEFT JOIN st ON st.page_id = l.page_id WHERE st.page_id IS NULL OR st.error <> ''", "links"),
    "resume_anti": with_views(_STATE + "SELECT l.* FROM links l WHERE page_id NOT IN (SELECT page_id FROM st WHERE error = '') AND page_id % 7 <> 0", "links"),
    "dead_letter": "WITH " + _STATE + "SELECT DISTINCT page_id FROM st WHERE error <> '' AND page_id % 2 <> 0",
    "outcome_rollup": "WITH " + _STATE + "SELECT CASE WHEN error <> '' THEN 'error' WHEN available THEN 'hit' ELSE 'miss' END AS outcome, count(*) AS n FROM st GROUP BY 1",
    "missing_links": with_views(_DUMP + "SELECT DISTINCT article_link FROM links WHERE article_link NOT IN (SELECT article_link FROM dump WHERE wayback_url <> '')", "links"),
    "merge_existing_wins": with_views(_DUMP + "SELECT article_link, arg_min(wayback_url, struct_pack(a := page_id >= 1000000, b := wayback_url)) AS wayback_url FROM dump GROUP BY 1", "links"),
    "host_family": with_views(f"SELECT page_id, CASE WHEN {_fam('example.com')} THEN 'a' WHEN {_fam('example.net', 'example.org')} THEN 'b' END AS source FROM links", "links"),
    "host_histogram": with_views(f"SELECT {_H} AS host, count(*) AS n FROM links GROUP BY 1", "links"),
    "distinct_keys": with_views(f"SELECT count(DISTINCT {_exact('url')}) AS exact_keys, count(DISTINCT {_id('url')}) AS ids, count(DISTINCT {_clean('url')}) AS clean_keys FROM capture_log", "capture_log"),
    "distinct_links": with_views("SELECT DISTINCT url FROM capture_log", "capture_log"),
    "unmatched_examples": with_views(_DUMP + "SELECT DISTINCT article_link FROM links WHERE article_link NOT IN (SELECT article_link FROM dump) ORDER BY 1 LIMIT 5", "links"),
    "domain_check": with_views(_CHECK.format(_fam("example.com", "example.net")), "links"),
    "host_check_valid": with_views(_CHECK.format(_fam("example.com", "example.net", "example.org")), "links"),
    "jsonl_scan": "SELECT count(*) FILTER (doc_id % 11 <> 0 AND doc_id % 13 <> 0) AS rows, count(*) FILTER (doc_id % 11 <> 0 AND doc_id % 13 = 0) AS without_key, count(*) FILTER (doc_id % 11 = 0) AS invalid FROM documents",
    "json_array_scan": "SELECT page_id, url, kind FROM pages CROSS JOIN (VALUES ('array'), ('lines')) k(kind)",
    "csv_round_trip": "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents WHERE text <> ''",
    "page_edges": _EDGE_PAGES + "SELECT page_id, '/c/en/' || a AS start_path, lang || b || '/n' AS end_path, rel, weight FROM e WHERE i % 11 <> 0",
    "key_sketches": with_views(f"SELECT key, n, true AS near, true AS merged_as_whole FROM (SELECT 'exact' AS key, count(DISTINCT {_exact('url')}) AS n FROM capture_log UNION ALL SELECT 'clean', count(DISTINCT {_clean('url')}) FROM capture_log UNION ALL SELECT 'events', count(DISTINCT event_id) FROM capture_log)", "capture_log"),
    "commit_rewrites": with_views("SELECT page_id, article_link FROM links WHERE page_id % 3 > 0", "links"),
    "latest_complete_run": with_views("SELECT '2024-01-02' AS run, run AS run_kind, model_path, sample_id, predicted_label FROM predictions WHERE sample_id % 3 >= 1", "predictions"),
    "json_ld_fields": r"""WITH t AS (SELECT page_id, page_id % 4 AS kind, trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages)
SELECT page_id, CASE kind WHEN 1 THEN 'S ' || title WHEN 3 THEN 'T' END AS section, CASE kind WHEN 1 THEN 'Report' WHEN 2 THEN 'BlogPosting' WHEN 3 THEN 'Thing' END AS news_type, CASE kind WHEN 2 THEN 'D ' || title END AS description,
  CASE kind WHEN 2 THEN '2020-01-01' WHEN 3 THEN '2021' END AS published_date, CASE kind WHEN 1 THEN 'k1;k2' END AS keywords, CASE kind WHEN 1 THEN title || ';Bob' END AS author_name, CASE kind WHEN 1 THEN 'Person' END AS author_type FROM t""",
    "page_concept_edges": _EDGE_PAGES + "SELECT concept, CASE WHEN a = concept THEN b ELSE a END AS other, rel, max(weight) AS weight FROM e WHERE i % 11 <> 0 AND weight >= 1 AND (a <> concept OR lang = '/c/en/') GROUP BY ALL",
    "stream_per_day": with_views(_PER_DAY, "capture_log"),
    "url_variants": with_views(_VARIANTS + "SELECT page_id, string_agg(x, ' ' ORDER BY i) AS variants FROM v4 GROUP BY page_id", "links"),
    "capture_url": with_views("SELECT page_id, 'https://web.archive.org/web/20240101000000/' || " + _quoted("article_link || '?q=é|\"<x y>*+~%41#z'") + " AS capture, '20240101000000' AS ts FROM links", "links"),
    "captures_per_day": with_views(_PER_DAY, "capture_log"),
    "page_title": "SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages",
    "field_choice": """WITH c AS (SELECT page_id, 'title' AS field, 0 AS rank, 0 AS ordinal, regexp_extract(html, '<title>(.*?)</title>', 1) AS value FROM pages UNION ALL SELECT page_id, 'title', 1, 1, regexp_extract(html, '<h1>(.*?)</h1>', 1) FROM pages UNION ALL SELECT page_id, 'nav', 0, 2, regexp_extract(html, '<a [^>]*>(.*?)</a>', 1) FROM pages)
SELECT page_id, field, arg_min(trim(value), rank * 1000 + ordinal) AS value FROM c WHERE trim(value) <> '' GROUP BY 1, 2""",
    "dedupe_keep_order": """WITH a AS (SELECT page_id, regexp_extract_all(html, '<a [^>]*>(.*?)</a>', 1) AS v FROM pages), b AS (SELECT page_id, trim(regexp_replace(unnest(v), '\\s+', ' ', 'g')) AS x, unnest(range(len(v))) AS i FROM a),
c AS (SELECT page_id, lower(x) AS k, arg_min(x, i) AS x, min(i) AS i FROM b WHERE x <> '' GROUP BY 1, 2), d AS (SELECT page_id, string_agg(x, '|' ORDER BY i) AS nav FROM c GROUP BY 1)
SELECT p.page_id, coalesce(d.nav, '') AS nav FROM pages p LEFT JOIN d ON d.page_id = p.page_id""",
    "enrich": with_views(f"""s AS ({_latest(_canon('url'))}), c AS (SELECT {_canon('url')} AS key, max(length(html)) AS html_chars FROM pages GROUP BY 1)
SELECT p.page_id, p.key, s.key IS NOT NULL AS available, s.ts, s.url AS capture, CASE WHEN s.key IS NOT NULL THEN c.html_chars END AS html_chars
FROM (SELECT page_id, {_canon('url')} AS key FROM pages) p LEFT JOIN s ON s.key = p.key LEFT JOIN c ON c.key = p.key""", "capture_log"),
}
