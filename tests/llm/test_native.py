import functools
import hashlib
import uuid
import zlib
from html.parser import HTMLParser

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pressmill.llm import chat, decontam, digest_index, queries, sharding, urlfilter, warc

SF = "/root/testdata/sf0.001"


# ---- chat

def render(turns, me):
    out, spans = "", []
    for _, role, text in turns:
        out += "<|assistant|>\n" if role == me else "<|system|>\n" if role == "system" else f"<|user name={role}|>\n"
        start = len(out)
        out += text + "<|end|>\n"
        if role == me:
            spans.append((start, len(out) - 1))
    return out, spans


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo 🙂"), (1, 3, "ann", None), (1, 3, "cy", "tie"), (1, 2, "bob", "yo 🙂"), (2, 0, "system", "alone"), (None, None, None, "lost"), (3, 5, "ann", "x" * 5000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, perspective int")
    got = {(r["conv_id"], r["perspective"]): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "cy"), (None, "unknown"), (3, "ann")}
    turns = [(0, "system", "be nice"), (1, "ann", "hi"), (2, "bob", "yo 🙂"), (3, "ann", ""), (3, "cy", "tie")]
    for me in ("ann", "bob", "cy"):
        text, spans = render(turns, me)
        r = got[1, me]
        assert r["text"] == text and [tuple(s) for s in r["spans"]] == spans and r["n_turns"] == 5
    assert chat.rotate(df.limit(0)).count() == 0


def test_long_chat_comes_in_parts(spark):
    rows = [(1, t, "ab"[t % 2], f"turn {t}") for t in range(300)] + [(1, 500, "abc"[i % 3], f"tied {i:04}") for i in range(600)] + [(None, None, "a", f"lost {i}") for i in range(30)]
    df = spark.createDataFrame([*rows, *rows[:50]], "conv_id long, turn long, role string, text string")
    got = chat.rotate(df, part_rows=16).collect()
    turns = sorted(((t, r, x) for c, t, r, x in rows if c == 1))
    for me in "abc":
        parts = sorted((r for r in got if r["conv_id"] == 1 and r["perspective"] == me), key=lambda r: r["part"])
        text, spans = render(turns, me)
        assert [r["part"] for r in parts] == list(range(-(-900 // 16))) and "".join(r["text"] for r in parts) == text
        assert [(s["start"] + r["char_offset"], s["end"] + r["char_offset"]) for r in parts for s in r["spans"]] == spans
    assert {r["perspective"] for r in got if r["conv_id"] is None} == {"a"} and sum(r["n_turns"] for r in got if r["conv_id"] is None) == 30


def test_marks_in_texts_and_roles_are_told_from_marks(spark):
    rows = [(1, 0, "a|>\n<|system", "x<|end|>\n<|assistant|>"), (1, 1, "b", "<\\|end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    text = {r["perspective"]: r["text"] for r in chat.rotate(df).collect()}["b"]
    assert text == "<|user name=a|\\> <\\|system|>\nx<\\|end|>\n<\\|assistant|><|end|>\n<|assistant|>\n<\\\\|end|><|end|>\n"


def test_chat_equals_its_sql(spark):
    import duckdb

    rows = [(c, t, r, x) for c in (1, 2, None) for t in (None, 0, 3, 3, 9) for r in ("a", "system", None, "q|>\nz") for x in ("hi", None, "<|end|>", "<\\|", "é🙂")]
    rows += [(7, 1, "a" if i % 2 else "b", f"crowd {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    got = chat.rotate(df).select("conv_id", "perspective", "part", "char_offset", "n_turns", "text", spans.alias("mask_spans")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(queries.ORACLE["op1_chat_perspectives"]).fetchall()))


# ---- WARC

class PlainPage(HTMLParser):
    """The same rules by the parser of the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.links, self.lang, self.charset, self.titles, self.silent, self.pre, self.in_title = [""], [], "", "", [], 0, 0, False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}
        self.silent += tag in warc.SILENT
        if self.silent:
            return
        if tag in warc.BLOCKS:
            self.lines.append("")
            self.pre += tag == "pre"
            if tag == "title":
                self.in_title = not self.titles
                self.titles.append("")
        if tag == "a" and a.get("href", "").strip():
            self.links.append("".join(a["href"].split()))
        if tag == "html":
            self.lang = self.lang or a.get("lang", "").strip()
        if tag == "meta":
            told = a.get("content", "").lower().partition("charset=")[2]
            self.charset = self.charset or a.get("charset", "").strip() or told.strip()

    def handle_endtag(self, tag):
        if tag in warc.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in warc.BLOCKS and not self.silent:
            self.lines.append("")
            self.pre -= tag == "pre" and self.pre > 0
            self.in_title = False

    def handle_data(self, data):
        if self.silent:
            return
        if self.in_title:
            self.titles[0] += data
        first, *rest = data.split("\n") if self.pre else [data]
        self.lines[-1] += first
        self.lines += rest


def plain_page(page):
    p = PlainPage()
    p.feed(page or "")
    p.close()
    lines = [" ".join(x.split()) for x in p.lines]
    return {"title": " ".join((p.titles or [""])[0].split()), "language": p.lang, "charset": p.charset, "links": p.links, "text": "\n".join(x for x in lines if x)}


ODD_PAGES = [
    "", "no tag", "<p>caf&eacute; &#8217; &mdash; &amp;lt; &unknown; &#x1F642;</p>", "a < b and 3 <4", "<a href='x y'>1</a><a href=z>2</a><A HREF=\"q&amp;r\">3</A><a name=n>4</a>",
    "<title>One &ndash; <b>two</b></title><title>no</title>", "<pre>a\n  b</pre>c\nd<br/>e", "x<script>if (a<b) '</p>'</script >y<style>p{}</style>z<noscript><p>n</p></noscript>", "<html lang='de'><meta http-equiv=x content='text/html; charset=utf-8'>",
    "<p title=\"a>b\">quoted</p>", "x<!-- y --> z <!doctype html> t", "<b> one</b>two<i>three </i>four", "<div\nclass='c'\n>in</div>", "<td>1<td>2</table>",
]


def test_warc_pages_equal_the_standard_parser(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    for page in [*ODD_PAGES, *pages]:
        assert warc.read_page(page) == plain_page(page), page[:300]


def test_long_and_broken_pages_take_one_pass():
    import time

    for part in ("<script>", "<!--", "<a <a ", "<a '", '<a "<p>', "<", "</", "&amp", "<title>", "<p>" + "word " * 20):
        began = time.time()
        warc.read_page(part * 200_000)
        assert time.time() - began < 10, part
    assert warc.read_page("one<!-- two <p>three")["text"] == "one" == warc.read_page("one<script> two")["text"] == warc.read_page("one<p two")["text"]


def test_warc_records(spark):
    html = '<html lang="en"><head><title>A &amp; B</title><script>x="<p>"</script></head><body><p>One  two</p><p>Three<br>four</p><a href="/l">l</a></body></html>'
    rows = [(1, "http://a/", html, 5), (2, None, None, 5), (1, "http://a/", html, 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, block int")
    source = warc.responses(df)
    out = warc.derive(source).collect()
    assert len(out) == 6 and len({r["record_id"] for r in out}) == 4  # a repeated row gives its records again
    by = {(r["page_id"], r["warc_type"]): r for r in out}
    ids = {r["page_id"]: r["record_id"] for r in source.collect()}
    text = by[1, "conversion"]
    assert text["block"] == "A & B\nOne two\nThree\nfour\nl" and text["refers_to"] == ids[1]
    assert text["payload_digest"] == by[1, "metadata"]["payload_digest"] == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    assert text["block_digest"] == "sha256:" + hashlib.sha256(text["block"].encode()).hexdigest() and text["content_length"] == len(text["block"].encode())
    meta = by[1, "metadata"]["block"]
    assert "title: A & B\r\n" in meta and "language: en\r\n" in meta and "outlink: /l\r\n" in meta and "source-header: Content-Type: text/html; charset=utf-8\r\n" in meta
    assert by[2, "conversion"]["block"] == "" and by[2, "conversion"]["target_uri"] == ""
    uuid.UUID(text["record_id"][10:-1])
    assert warc.derive(warc.responses(df.limit(0))).count() == 0
    bare = source.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in source.schema])
    assert {r["block"] for r in warc.derive(bare).collect()} > {""}


def test_warc_file_round_trip(spark, tmp_path):
    records = queries.op2_warc_derivatives(spark, SF).coalesce(1)
    warc.write(records, f"file://{tmp_path}/out")
    warc.write(records, f"file://{tmp_path}/zipped", "gzip")
    import gzip

    data = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*"))
    assert data == b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "zipped").glob("part-*"))
    seen = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        size = int(fields[b"Content-Length"])
        assert rest[size : size + 4] == b"\r\n\r\n" and b"sha256:" + hashlib.sha256(rest[:size]).hexdigest().encode() == fields[b"WARC-Block-Digest"]
        seen.append(fields[b"WARC-Record-ID"])
        data = rest[size + 4 :]
    assert len(seen) == records.count() and len(set(seen)) == len(seen)


# ---- decontamination

QUESTION = "If Alice walks 12 km to the old mill, and Bob walks 7 km back, then how far do Alice and Bob walk together in a day?"


def test_reparameterised_question_is_found(spark):
    other = QUESTION.replace("Alice", "Zed").replace("Bob", "Yara").replace("12", "31").replace(" 7 ", " 9.5 ")
    mixed = QUESTION.replace("Alice", "Zed", 1).replace("Bob", "Zed", 1)  # one name for two, and two for one
    docs = [(1, "Some words before. " + QUESTION + " After it."), (2, "Well, here. " + other), (3, "Nothing of the kind is in this text at all, not a bit of it."), (4, None), (5, ""), (6, mixed), (2, "Well, here. " + other)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(10, QUESTION), (11, None), (12, ""), (13, "five words that stand here"), (14, "7 8 9")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(df, bench).collect()}
    assert set(got) == {(1, 10), (2, 10)}
    assert got[1, 10]["changed_slots"] == 0 and got[2, 10]["changed_slots"] == 4 and got[2, 10]["consistency"] == 1.0
    assert {r["doc_id"] for r in decontam.leaks(df, bench, min_consistency=0.0).collect()} == {1, 2, 6}
    assert decontam.leaks(df.limit(0), bench).count() == 0 and decontam.leaks(df, bench.limit(0)).count() == 0
    short = spark.createDataFrame([(1, "x y five words that stand here z")], "doc_id long, text string")
    assert [r["item_id"] for r in decontam.leaks(short, bench).collect()] == [13]


def test_several_versions_in_one_text_are_found(spark):
    other = QUESTION.replace("Alice", "Zed").replace("Bob", "Yara").replace("12", "31").replace(" 7 ", " 9.5 ")
    third = other.replace("31", "44").replace("9.5", "3").replace("in a day", "on a fine day")
    mixed = QUESTION.replace("Alice", "Zed", 1).replace("Bob", "Zed", 1)
    docs = spark.createDataFrame([(1, f"{QUESTION} {other} {third}"), (2, f"{other} Some words go between. {QUESTION}"), (3, f"{mixed} And then. {mixed}")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, QUESTION), (11, third)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(docs, bench).collect()}
    assert set(got) == {(1, 10), (1, 11), (2, 10), (2, 11)}
    assert got[1, 10]["changed_slots"] == 0 == got[2, 10]["changed_slots"] and got[1, 11]["coverage"] == 1.0


def test_items_of_one_template_are_found_once(spark):
    """Ten items of a template and twenty documents of it: twenty rows and ten members."""
    item = lambda i: QUESTION.replace("Alice", f"A{'bcdefghijk'[i % 10]}").replace("12", str(50 + i)).replace(" 7 ", f" {i + 20} ")
    bench = spark.createDataFrame([(i, item(i)) for i in range(10)] + [(90, item(3).replace("53", "23"))], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"Before it. {item(i)} After.") for i in range(20)], "doc_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()]
    members = {r["item_id"]: r["class_id"] for r in decontam.item_classes(bench).collect()}
    assert members == {i: 0 for i in range(10)} | {90: 90}  # 90 has one value in two slots
    assert sorted(g for g in got if g[1] == 0) == [(i, 0) for i in range(20)] and len(got) == len(set(got))


def test_written_numbers_and_other_cases_are_found(spark):
    text = "a farmer has seven cows and sells three of them to each of two friends, so how many cows are left in the forty-two barns?"
    docs = [
        (1, text.replace("seven", "eight").replace("forty-two", "ninety nine")), (2, text.replace("seven", "7").replace("forty-two", "42")), (3, text.upper()), (4, QUESTION.upper()), (5, QUESTION.lower()), (6, QUESTION.title()),
        (7, QUESTION.replace("12 km", "twelve km").replace(" 7 ", " Thirty-Five ")), (8, text.replace("cows", "pigs").replace("farmer", "smith").replace("sells", "eats")), (9, text.replace("seven", "three").replace("three of", "one of")),
    ]
    bench = spark.createDataFrame([(10, text), (11, QUESTION)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 10), (2, 10), (3, 10), (4, 11), (5, 11), (6, 11), (7, 11), (9, 10)} == plain_leaks(docs, [(10, text), (11, QUESTION)])
    none = {r["doc_id"] for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench, number_words={}).collect()}
    assert {3, 4, 5, 6} <= none


def test_opening_names_units_and_long_runs_are_found(spark):
    names = "Tom has 5 apples. Sue gives Tom 3 apples. How many apples has Tom now?"
    long = " ".join(f"{c}{d}" for c in ("ba", "ce", "di", "fo", "gu") for d in ("lm", "nt", "rs", "vx", "zk", "pq", "hj", "st", "kl", "mn", "wr", "tt", "ss", "ll"))
    units = "the boat goes 5 km down,\nAnn said, and then it goes 7 km up again"
    docs = spark.createDataFrame([(1, names.replace("Tom", "Ed").replace("Sue", "Kay")), (2, "quite other words " + " ".join(long.split()[20:48]) + " and so on"), (3, units.replace("5 km", "6km").replace("7 km", "8km").replace("\nAnn", "  Eve")), (4, " ".join(long.split()[20:34]))], "doc_id long, text string")
    bench = spark.createDataFrame([(10, names), (11, long), (12, units)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()} == {(1, 10), (2, 11), (3, 12)}


ALL_NUMBERS = {w for own in decontam.NUMBER_WORDS.values() for w in own}


@functools.lru_cache(maxsize=None)
def plain_tokens(text, openers, names=True):
    """Tokens as (template, value or None)."""
    import regex

    out, t, number = [], " ".join((text or "").split()), False
    for m in regex.finditer(r"(?P<num>\p{N}+(?:[.,]\p{N}+)*)|(?P<word>[\p{L}\p{M}]+)", t):
        word, at = m[0], m.start()
        if m["num"]:
            out.append(("#", word))
            number = False
            continue
        before = t[max(0, at - 2) : at]
        alone = not regex.search(r"\p{N}$", before) and not regex.match(r"\p{N}", t[m.end() :])
        if word.lower() in ALL_NUMBERS and alone:
            if number and before[-1:] in (" ", "-") and regex.search(r"\p{L}.$", before):
                out[-1] = ("#", out[-1][1] + word.lower())
            else:
                out.append(("#", word.lower()))
            number = True
            continue
        if word.lower() in decontam.UNITS and (regex.search(r"\p{N} ?$", before) or number and regex.search(r"\p{L} $", before)) and not regex.match(r"[\p{N}]", t[m.end() :]):
            out.append(("%", word.lower()))
        elif names and regex.match(r"\p{Lu}", word) and (regex.search(r"[\p{L}\p{N},;:] $", before) or (openers and not regex.search(r"[\p{L}\p{M}\p{N}]$", before))):
            out.append(("@", word.lower()))
        else:
            out.append((word.lower(), None))
        number = False
    return out


PLAIN_VARIANTS = [(False, True), (True, True), (True, False)]


def plain_leaks(docs, bench):
    """Items by document: windows, occurrences and slots by plain loops."""
    found = set()
    windows = lambda toks, n: [(i, tuple(x for x, _ in toks[i : i + n]), toks[i : i + n]) for i in range(len(toks) - n + 1)]
    for item, text in bench:
        held = {}
        for variant in PLAIN_VARIANTS:
            toks = plain_tokens(text, *variant)
            n = min(len(toks), decontam.K)
            for i, key, part in windows(toks, n) if n else []:
                if sum(v is None for _, v in part) >= min(decontam.MIN_LITERALS, n):
                    held.setdefault(key, []).append((i, part))
        if not held:
            continue
        places = {i for v in held.values() for i, _ in v}
        width = max(places) - min(places) + 1
        for doc, body in docs:
            hits = []
            for variant in PLAIN_VARIANTS:
                for i, key, part in windows(plain_tokens(body, *variant), n):
                    hits += [(b, i - b, [(x[1], y[1]) for x, y in zip(want, part) if x[1] is not None]) for b, want in held.get(key, [])]
            for way in (lambda s: ("all",), lambda s: ("at", s), lambda s: ("even", s // width), lambda s: ("odd", (s + width // 2) // width)):
                for place in {way(s) for _, s, _ in hits}:
                    own = [h for h in hits if way(h[1]) == place]
                    met = {b for b, _, _ in own}
                    run = place[0] == "at" and any(set(range(b, b + decontam.MIN_RUN)) <= met for b in met)
                    if len(met) / len(places) < decontam.MIN_COVERAGE and not run:
                        continue
                    pairs = {p for _, _, v in own for p in v}
                    fit = {b for b, d in pairs if sum(x == b for x, _ in pairs) == 1 == sum(y == d for _, y in pairs)}
                    if not pairs or len(fit) / len({b for b, _ in pairs}) >= decontam.MIN_CONSISTENCY:
                        found.add((doc, item))
    return found


def test_leaks_equal_a_plain_matcher(spark):
    names = "Tom has 5 apples. Sue gives Tom 3 apples. How many apples has Tom now?"
    other = QUESTION.replace("Alice", "Zed").replace("Bob", "Yara").replace("12", "31").replace(" 7 ", " 9.5 ")
    mixed = QUESTION.replace("Alice", "Zed", 1).replace("Bob", "Zed", 1)
    new = names.replace("Tom", "Ed").replace("Sue", "Kay").replace("5", "8")
    extra = [
        (9001, f"{QUESTION} {other}"), (9002, f"{other} Between them. {other.replace('31', '44')} {QUESTION}"), (9003, mixed), (9004, f"{new} {names}"), (9005, f"And then {new}"), (9006, f"{mixed} {mixed} {other}"),
        (9007, QUESTION.replace("walks", "slowly walks")), (9008, None), (9009, ""), (9010, "Four Score And Seven 7 km x 8km. The 5 dollars"), (9011, other[:60]), (9012, "Tom5 has 3.5 kg, Ann 4kg of O'Neil's"), (9013, names.upper()),
    ]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(9101, QUESTION), (9102, names), (9103, other), (9104, "five words that stand here"), (9105, "7 8 9"), (9106, None), (9107, "Tom5 has 3.5 kg, Ann 4kg of O'Neil's")]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + extra
    table = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string").repartition(4)
    items = {}
    for r in decontam.item_classes(table(bench, "item_id")).collect():
        items.setdefault(r["class_id"], []).append(r["item_id"])
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(table(docs, "doc_id"), table(bench, "item_id")).collect()}
    assert {(d, i) for d, c in got for i in items[c]} == plain_leaks(docs, bench)
    assert items[9101] == [9101, 9103] or items[9101] == [9103, 9101]
    assert {(9001, 9101), (9002, 9101), (9002, 9103), (9004, 9102), (9005, 9102), (9006, 9101)} <= {(d, i) for d, c in got for i in items[c]} and not {d for d, _ in got} & {9003, 9008, 9009}
    assert (9013, 9102) in got


def test_planted_passages_are_found(spark):
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {(d["doc_id"], i) for d in docs for i, t in bench.items() if t in d["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op4_template_decontamination(spark, SF).collect()}
    assert want <= got and len(got) <= len(want) + 2


# ---- URL rules

def judge(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def test_url_rules_equal_a_plain_scan(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/", "allow"), ("b.example.net", "/en/x", "block"), ("example.com", "/de/", "block"), ("com", "/design", "allow"), ("example", "/", "block")]
    hosts = ["example.net", "a.example.net", "b.example.net", "c.b.example.net", "xexample.net", "net", "EXAMPLE.com", "example.com:80", "example", "été.example.com", ""]
    paths = ["", "/", "/en/", "/en/x/y", "/en", "/de/1", "/design", "/en/x?q=/de/", "#/en/", "?a=://b/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "a://b://c/d", "http:/x"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*urls, *urls])], "page_id long, url string, host string")
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("net", None, "block")], "host string, path string, verdict string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    for ranges in (1, 3, 11):  # ranges that begin anywhere among the rules and probes
        try:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
            spark.conf.set("spark.sql.shuffle.partitions", ranges)
            got = urlfilter.judge(df, table)
            assert got.columns == ["page_id", "url", "host", "judged"]
            found = got.collect()
        finally:
            for k, v in kept.items():
                spark.conf.set(k, v)
        assert len(found) == 2 * len(urls)
        for r in found:
            j = r["judged"]
            assert (j["host"], j["path"], j["rule"], j["verdict"]) == judge(r["url"], rules), (r["url"], ranges)
    assert urlfilter.judge(df.withColumnRenamed("host", "judged"), table).columns == ["page_id", "url", "judged"]
    assert {r["judged"]["verdict"] for r in urlfilter.judge(df, table.limit(0)).collect()} == {"allow"}
    assert urlfilter.judge(df.limit(0), table).count() == 0


# ---- digest index

def test_index_keeps_and_appends(spark):
    rows = [(1, "Same"), (2, "sAME"), (3, "other"), (4, None), (5, ""), (6, "ÄB"), (7, "äb"), (7, "äb"), (None, "lone"), (None, "Same")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, digest int")
    index = digest_index.new_index(spark, buckets=4)
    got = sorted(((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in index.add(df).collect()), key=str)
    assert got == sorted([("1", 2, 3, False), ("2", 2, 3, True), ("3", 3, 1, True), ("4", 5, 2, False), ("5", 5, 2, True), ("6", 6, 1, True), ("7", 7, 2, True), ("7", 7, 2, True), ("None", None, 1, True), ("None", 2, 3, False)], key=str)
    again = digest_index.DigestIndex(spark, index.location)  # opened anew
    more = spark.createDataFrame([(50, "SAME"), (51, "fresh")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in again.add(more).collect()) == [(50, 2, False), (51, 51, True)]
    assert again.table().count() == 7
    assert again.add(more.limit(0)).count() == 0
    # The same batches once more: rows that the index names are kept again.
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in again.add(more).collect()) == [(50, 2, False), (51, 51, True)]
    retried = sorted(((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in again.add(df).collect()), key=str)
    assert retried == sorted([g if g[:2] != ("None", None) else ("None", None, 1, False) for g in got], key=str) and again.table().count() == 7
    grown = again.rebuilt(index.location + "_grown", 9)
    assert grown.buckets == 9 and sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in grown.add(more).collect()) == [(50, 2, False), (51, 51, True)]
    grown.close(delete=True)


def test_a_named_batch_keeps_its_null_ids_when_retried(spark):
    df = spark.createDataFrame([(None, "lone"), (None, "two"), (1, "two")], "doc_id long, text string")
    index = digest_index.new_index(spark)
    first, again, other = (sorted(index.add(df, batch=b).select("doc_id", "kept").collect(), key=str) for b in ("b1", "b1", "b2"))
    assert first == again and sum(r["kept"] for r in first) == 2 and sum(r["kept"] for r in other) == 1


# ---- shards

def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1), min_size=1, max_size=50))
def _jump_property(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for r in df.select("k", *[sharding.jump_hash(F.col("k"), n).alias(f"s{n}") for n in (1, 2, 16, 17, 5000)]).collect():
        assert [r["s1"], r["s2"], r["s16"], r["s17"], r["s5000"]] == [jump(r["k"], n) for n in (1, 2, 16, 17, 5000)]


def test_jump_hash(spark):
    import random

    draw = random.Random(3)
    _jump_property.hypothesis.inner_test(spark, [0, 1, -1, (1 << 63) - 1, -(1 << 63)] + [draw.getrandbits(64) - (1 << 63) for _ in range(500)])


def test_shards_and_slots(spark):
    rows = [(i, f"text {i} é") for i in range(3000)] + [(5, "text 5 é")] * 500 + [(None, None), (None, "")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, size int")
    got = sharding.shard(df, 16, chunk_rows=50).collect()
    assert len(got) == len(rows)
    for s in range(16):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in got)
    import xxhash

    for r in got:  # the shard by plain computation from the id
        key = xxhash.xxh64_intdigest(str(r["doc_id"]) if r["doc_id"] is not None else "null", seed=42)
        assert (r["shard"], r["grown_shard"]) == (jump(key, 16), jump(key, 17))
    moved = sum(r["grown_shard"] == 16 for r in got if r["doc_id"] is not None and r["doc_id"] != 5) / 2999
    assert 0.03 < moved < 0.09
    for r in got:
        if r["doc_id"] is not None:
            t = f"text {r['doc_id']} é".encode()
            assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t)
    assert {r["size"] for r in got if r["doc_id"] is None} == {1}
    assert sharding.shard(df.limit(0), 16).count() == 0


def test_an_index_knows_its_buckets(spark):
    """Opened again with another session's default, and with a wrong number."""
    import pytest

    docs = spark.createDataFrame([(i, f"text {i % 30}") for i in range(40)], "doc_id long, text string")
    index = digest_index.new_index(spark, buckets=3)
    assert index.add(docs).filter("kept").count() == 30
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        index.close()  # out of the catalog, as for another session
        for again in (digest_index.DigestIndex(spark, index.location), digest_index.DigestIndex(spark, index.location, buckets=3, id_type="bigint")):
            assert again.buckets == 3
            got = again.add(docs.withColumn("doc_id", F.col("doc_id") + 1000))
            assert got.count() == 40 and got.filter("kept").count() == 0 and again.table().count() == 30
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for wrong in ({"buckets": 8}, {"id_type": "string"}, {"buckets": 4, "id_type": "bigint"}):
        with pytest.raises(ValueError, match="the index at"):
            digest_index.DigestIndex(spark, index.location, **wrong)
    bare = index.location + "_bare"
    docs.write.parquet(bare)
    with pytest.raises(ValueError, match="no record"):
        digest_index.DigestIndex(spark, bare)
    again.close(delete=True)
