"""Articles, their names and links, on literal pages."""

from folio.operators import articles

PAGE = (
    '<body><div id="contenu">notice</div><div id="tabpanel-rcp-panel"><div class="fr-col">nav</div><div id="contenu"><button>b</button>'
    '<p class="AmmAnnexeTitre1"><a name="RcpDenomination">1. DENOMINATION</a></p><p> </p><p>DOLIPRANE 500</p><div class="x fr-no-print">share</div></div></div></body>'
)


def test_article_is_the_panels_content_column(spark):
    got = articles.articles(spark.createDataFrame([(1, PAGE), (2, "<p>no panel</p>"), (3, None), (4, '<div id="tabpanel-rcp-panel"><div id="contenu"><p>no title</p></div></div>')], "key long, html string"))
    by = {r["key"]: (r["html"], r["name"]) for r in got.collect()}
    assert by[2] == by[3] == by[4] == ("", "")
    html, name = by[1]
    assert name == "DOLIPRANE 500" and "button" not in html and "share" not in html and "notice" not in html
    assert html.startswith('<!DOCTYPE html>\n<html>\n<body><div id="textDocument"><p class="AmmAnnexeTitre1">') and html.endswith("</div></body>\n</html>")


def test_links_skip_anchors_and_titles(spark):
    html = '<p class="AmmAnnexeTitre1">Aspirine</p><!-- aspirine --><p><a href="/x">aspirine</a> x_aspirine, Ibuprofène et <b>aspirine</b></p>'
    terms = spark.createDataFrame([("ASPIRINE", "7", "7-aspirine"), ("IBUPROFENE", "1", "1-ibu")], "term string, key string, slug string")
    got = {r["key"]: (r["html"], r["slugs"]) for r in articles.linked(spark.createDataFrame([("1", html), ("2", None)], "key string, html string"), terms).collect()}
    assert got["1"][1] == ["7-aspirine"] and got["2"] == ("", [])
    assert got["1"][0].count("drug-xref") == 1 and 'x_<a class="drug-xref" href="/rcp/7-aspirine">aspirine</a>, Ibuprofène' in got["1"][0]


def test_links_leave_scripts_and_everything_else_alone(spark):
    html = '<script>var aspirine = 1;</script>\n<style>.aspirine{}</style><br>é &amp; 😀 <p class="AmmDenomination"><b>aspirine</b></p>\n<p>aspi&eacute; ASPIRINE b<p>beta beta</i> gamma'
    terms = spark.createDataFrame([("ASPIRINE", "7", "7-a"), ("BETA", "8", "8-b\"<"), ("GAMMA", "9", "7-a"), ("B", "1", "self")], "term string, key string, slug string")
    docs = spark.createDataFrame([("1", html), ("2", "no terms"), ("3", "")], "key string, html string")
    got = {r["key"]: (r["html"], r["slugs"]) for r in articles.linked(docs, terms).collect()}
    a = lambda slug, text: f'<a class="drug-xref" href="/rcp/{slug}">{text}</a>'
    want = html.replace("ASPIRINE", a("7-a", "ASPIRINE")).replace("<p>beta", "<p>" + a("8-b&quot;&lt;", "beta")).replace("gamma", a("7-a", "gamma"))
    assert got["1"] == (want, ["7-a", '8-b"<']) and got["2"] == ("no terms", []) and got["3"] == ("", [])
    few = {r["key"]: r["slugs"] for r in articles.linked(docs, terms, budget=1).collect()}
    assert few["1"] == ["7-a"]
