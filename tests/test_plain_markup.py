from pressmill.operators import pagetables

ROW = "<tr class='edge-main'><td class='edge-start'><a href='/c/en/a'>a</a><td class=\"edge-rel\"><span class='rel-label'><b>R &amp; S</b></span><div class='weight'>Weight: 1</div><td class='edge-end'><a href='/c/en/b/'>b</a></tr>"


def _parsed(html):
    page = pagetables._Edges()
    page.feed(html)
    page.close()
    while page.stack:
        page.handle_endtag(page.stack[-1])
    return page.rows


def test_plain_markup_has_the_parsers_rows_and_other_markup_goes_to_it():
    plain = [ROW, f"<table>{ROW}\n{ROW}</div></table>", ROW.replace("<tr ", "<TR  "), "", "text", ROW.split("<div")[0], ROW.replace("</a>", "<br></a ></i>")]
    other = [f"<!-- x -->{ROW}", ROW.replace("'/c/en/a'", "/c/en/a"), ROW.replace("/c/en/a", "/c/en/&amp;"), f"<title>{ROW}</title>", f"a < b {ROW}", f"{ROW}<", f"<script>{ROW}</script>{ROW}"]
    assert all(pagetables._plain_rows(h) == _parsed(h) for h in plain)
    assert all(pagetables._plain_rows(h) is None and list(pagetables.edges_of(h)) == _parsed(h) for h in other)


def test_rows_of_the_usual_shape_are_read_natively(spark):
    outer = f"<div><table>\n<tr><th>Start<th>End</tr>{ROW}\n{ROW}</table></div>".replace("&amp;", "+")
    row = ROW.replace("&amp;", "+")
    plain = [
        row, outer, "", "text", row.replace("'", '"').replace('""', '"'), row.replace("edge-main", "edge-main odd"), row.replace("<b>R + S</b>", "  R  "),
        row.replace("<a href='/c/en/a'>a</a>", "x <span class='term'><a class='t' href='/c/en/q' title='y'><i>a</i></a></span> y</td>\n"), row.replace("Weight: 1", "Weight: <em>0.5</em>"),
        row.replace("<div class='weight'>Weight: 1</div>", ""), row.replace("<span class='rel-label'><b>R + S</b></span>", "<div> </div>"), row.replace("Weight: 1", " heavy "), row.replace("Weight: 1", "Weight:"), f"<b>{row}</i></table>{row}",
    ]
    other = [
        ROW, f"<!-- x -->{row}", row.replace("'/c/en/a'", "/c/en/a"), f"<script>{row}</script>{row}", f"<title>{row}", f"a < b {row}", f"{row}<", row.replace("</tr>", ""), row.replace("edge-end", "edge-other"),
        f"{row}<tr class='edge-main'><td>", row.replace("<b>R", "<u>R"), f"\x02a\x01b\x01c\x01d\x03{row}", f"<p title=\"{row}\">", row.replace(">a<", "><a href='/c/en/z'>a<"), row.replace("R + S", "R S"), f"<SCRIPT>{row}",
        row.replace(" + ", " + "),
    ]
    pages = spark.createDataFrame(list(enumerate(plain + other)), "id int, html string")
    got = {r["id"]: r["rows"] for r in pagetables.native_rows(pages).collect()}
    same = lambda rows: [tuple(x or "" for x in r) for r in rows]
    weights = lambda rows: [(*r[:3], r[3].replace("Weight:", "").strip()) for r in same(rows)]
    for n, html in enumerate(plain):
        assert got[n] is not None and weights(got[n]) == weights(_parsed(html)), html
    assert [h for n, h in enumerate(other, len(plain)) if got[n] is not None and weights(got[n]) != weights(_parsed(h))] == []
    assert len([n for n in range(len(plain), len(got)) if got[n] is None]) >= len(other) - 2
    edges = {}
    for r in pagetables.page_edges(pages).collect():
        edges.setdefault(r["id"], []).append((r["start_path"], r["end_path"], r["rel"], r["weight"]))
    for n, html in enumerate(plain + other):
        numbers = [(a.rstrip("/"), b.rstrip("/"), c or "RelatedTo", w.replace("Weight:", "").strip()) for a, b, c, w in same(_parsed(html))]
        assert edges.get(n, []) == [(*r[:3], float(r[3])) for r in numbers if r[3] and r[3] != "heavy"], html


def test_pages_of_the_query_need_no_parser(spark, sf):
    from pressmill.plans import links

    assert pagetables.native_rows(links._edge_pages(spark, sf)).filter("rows IS NULL").count() == 0
