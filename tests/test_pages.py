import time

import pytest
from pyspark.sql import functions as F

from pressmill.operators import extract, pagetables


def ld(*blocks):
    return "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)


def fields(spark, html, **options):
    df = spark.createDataFrame([(1, html, "press")], "page_id long, html string, source string")
    return extract.page_metadata(df, **options).first()


@pytest.mark.parametrize("blocks, want", [
    (['{"@type": "WebPage", "articleSection": "web"}', '{"@type": "Report", "articleSection": "report"}'], {"section": "report", "news_type": "Report"}),
    (['{"@type": "Organization", "description": "org"}', '{"@type": "BlogPosting", "description": "post"}', '{"@type": "WebPage", "description": "web"}'], {"description": "post", "news_type": "BlogPosting"}),
    (['{"@graph": [{"@type": "WebPage", "description": "web"}, {"@type": ["X", "NewsArticle"], "description": "news", "keywords": ["a, b", "A"]}], "description": "outer"}'], {"description": "news", "news_type": "X", "keywords": ["a", "b"]}),
    (['{"@graph": [{"@graph": [[{"@type": "Article", "dateCreated": "2001"}]]}]}'], {"published_date": "2001"}),
    (['{"@type": "Person", "description": "first"}', '{"@type": "Thing", "description": "second"}'], {"description": "first", "news_type": "Person"}),
    (["not json", "", "7", '"text"', '{"@type": "Article", "description": " \\n "}'], {"description": None, "news_type": "Article"}),
    (['{"type": "Article", "author": {"name": ["Ann", "Ben"], "@type": "Person", "description": "writes"}}'], {"author_name": ["Ann", "Ben"], "author_type": ["Person"], "author_description": ["writes"], "news_type": "Article"}),
    (['{"@type": "Article", "author": [{"name": "Ann"}, "Bob", 5, null]}'], {"author_name": ["Ann", "Bob", "5"], "author_type": None}),
])
def test_the_primary_object_gives_the_fields(spark, blocks, want):
    row = fields(spark, ld(*blocks)).asDict()
    assert {k: row[k] for k in want} == want


def test_publisher_rule_blanks_and_times(spark):
    html = '<meta property="article:section" content=" \n "><b class="rubric"> The  Press </b><b class="section">World\n news</b><time> 1 May <i>2020</i></time><time datetime="2020-05-02">x</time><div class="byline">By <a>Ann</a></div><p class="bio">Likes tea</p>'
    avoid = {"section": {"press": ["the press"]}}
    row = fields(spark, html, source_col="source", avoid=avoid)
    assert (row["section"], row["published_date"], row["author_name"], row["author_description"]) == ("World news", "1 May 2020", ["Ann", "By Ann"], ["Likes tea"])
    assert fields(spark, html)["section"] == "The Press" == fields(spark, html, source_col="source", avoid={"section": {"other": ["the press"]}})["section"]
    assert fields(spark, html.split("<b class=\"section\"")[0], source_col="source", avoid=avoid)["section"] == "The Press"
    found = extract.page_candidates(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert {r["field"]: r["value"] for r in extract.field_choice(found, {"section": ["the press"]}).collect()}["section"] == "World news"


def test_elements_left_open_cost_little():
    n = 100_000
    began = time.time()
    for unit in ("<div>x", "<li>x", "<td class='section'>x", "<article>x", "<p>x<b>", "<a rel=tag>x", "</div>x", "<ul class=tags><a>x"):
        assert sum(1 for _ in extract.candidates_of("<title>t</title>" + unit * n)) >= 1
        extract.text_of(unit * n)
        list(pagetables.edges_of(unit * n))
    assert time.time() - began < 90


def test_lists_close_themselves(spark):
    html = "<ul class='tags'><li><a rel='tag'>One<li><a rel='tag'>Two</ul><table><tr><td class='section'>S<td>T</table><p>first<p class='rubric'>R"
    row = fields(spark, html)
    assert row["section"] == "R" and row["keywords"] == ["One", "Two"] or row["keywords"][0].startswith("One")


EDGES = """<html><body><h2>dog</h2><table class="table"><thead><tr><th>Start</th><th>Relation</th></tr></thead>
<tr class="edge-main"><td class="edge-start"><span class="lang">en</span> <a class="term" href="/c/en/dog/">a <b>dog</b></a></td>
  <td class="edge-rel"><div class="rel"><span class="rel-label"> <i>Is</i>A </span></div><div class="weight">Weight: <b>2.5</b></div></td>
  <td class="edge-end"><a href="/c/en/four_legged_animal/n/wn">animal</a><a href="/c/en/other">no</a></td></tr>
<tr class="edge-extra"><td class="edge-start"><a href="/c/en/x">x</a></td></tr>
<tr class="edge-main"><td class="edge-start"><a href="/c/en/bark"><td class="edge-rel"><div class="weight">Weight: 1</div><td class="edge-end"><a href="/c/en/dog/n">dog</a>
<tr class="edge-main"><td class="edge-start"><a href="/c/fr/chien">chien</a></td><td class="edge-rel"><span class="rel-label">Synonym</span><div class="weight">Weight: 3</div></td><td class="edge-end"><a href="/c/en/dog">dog</a></td></tr>
<tr class="edge-main"><td class="edge-start">no link</td><td class="edge-rel"><div class="weight">Weight: 3</div></td><td class="edge-end"><a href="/c/en/dog">dog</a></td></tr>
<tr class="edge-main"><td class="edge-start"><a href="/c/en/dog">dog</a></td><td class="edge-rel"><div class="weight">Weight: heavy</div></td><td class="edge-end"><a href="/c/en/cat">cat</a></td></tr>
</table></body></html>"""
SECOND = EDGES.replace("2.5", "4.0").replace("/c/en/bark", "/c/en/bark/v")


def test_edges_of_real_shaped_pages(spark):
    pages = spark.createDataFrame([(1, "dog", EDGES), (2, "dog", SECOND), (3, "cat", None), (4, "cat", "")], "page_id long, concept string, html string")
    edges = pagetables.page_edges(pages)
    assert [r[2:] for r in edges.filter("page_id = 1").collect()] == [
        ("/c/en/dog", "/c/en/four_legged_animal/n/wn", "IsA", 2.5), ("/c/en/bark", "/c/en/dog/n", "RelatedTo", 1.0), ("/c/fr/chien", "/c/en/dog", "Synonym", 3.0),
    ]
    got = sorted(pagetables.concept_edges(edges, min_weight=1.0).collect())
    assert [tuple(r) for r in got] == [("dog", "bark", "RelatedTo", 1.0), ("dog", "four_legged_animal", "IsA", 4.0)]  # paged tables meet in the largest
    assert pagetables.concept_edges(edges, min_weight=2.0).count() == 1
    pagetables.register(spark)
    pages.createOrReplaceTempView("edge_pages")
    assert spark.sql("SELECT page_id, label FROM edge_pages, LATERAL edge_rows(html)").count() == 8
    assert pagetables.page_edges(pages.limit(0)).count() == 0
    assert pagetables.page_edges(pages.select("page_id", "html", F.lit(1).alias("label"))).count() == 6
