"""Products on small pages."""

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from papertrawl.operators import products as P

SCHEMA = "item int, platform string, brand_hint string, url string, html string, payload string"


def products(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    return P.extract_products(df).orderBy("item").collect()


def test_cascade_and_drops(spark):
    graph = ('<script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":"Product","name":"Lamp",'
             '"offers":{"price":"12.5","availability":"http://schema.org/OutOfStock"},"image":"one.jpg"}]}</script>')
    state = '<script>window.__PRELOADED_STATE__ = {"z":{"name":"Zed","finalPrice":"₹10","mrpPrice":"₹20"},"a":{"title":"Later"}};</script>'
    rows = products(
        spark,
        ("amazon", None, "https://x/dp/ABCDEFGHIJ", graph, None),
        ("flipkart", None, "https://x/p/IT1", state, None),
        ("amazon", None, "https://x", "<p>robot check</p>", None),
        ("ebay", None, "https://x", graph, None),
        ("manual", "Croma", "https://c", '<div class="pd-title">Fan</div><b class="new-price">Rs. 1,200</b>', None),
        ("manual", "nobody", "https://n", "<p>no title</p>", None),
        ("swiggy", None, "https://s", "<p></p>", "not json"),
    )
    got = {r["item"]: r for r in rows}
    assert sorted(got) == [0, 1, 4, 5, 6]
    assert (got[0]["title"], got[0]["product_id"], got[0]["price"], got[0]["availability"]) == ("Lamp", "ABCDEFGHIJ", 12.5, "out_of_stock")
    assert got[0]["images"] == ["one.jpg"]
    assert (got[1]["title"], got[1]["price"], got[1]["discount"]) == ("Zed", 10.0, 50.0)
    assert (got[4]["title"], got[4]["price"], got[4]["brand"]) == ("Fan", 1200.0, "croma")
    assert got[5]["title"] == "https://n"
    assert got[6]["title"] == "Unknown"


def test_nested_and_unclosed_tags(spark):
    html = '<div id="outer"><p>one<p class="x y">two<br><b>three</div><p class="y">four'
    from pyspark.sql import functions as F

    from papertrawl.functions import dom as D

    dom = F.col("dom")
    row = spark.createDataFrame([(html,)], "html string").select(D.parse_dom("html").alias("dom")).select(
        D.text_of(dom, D.select_one(dom, "#outer")).alias("outer"), D.text_of(dom, D.select_one(dom, "p.x")).alias("inner"),
        F.size(D.select(dom, "div p")).alias("inside"), F.size(D.select(dom, ".y:not(.x)")).alias("without"),
        F.size(D.select(dom, "div > p")).alias("children"), F.size(D.select(dom, "b, br")).alias("either"),
    ).first()
    assert tuple(row) == ("one two three", "two three", 2, 1, 1, 2)


def test_the_rule_table_matches_like_the_expressions(spark):
    """Selectors found while reading a page against the same selectors as array expressions, in whole pages and below elements."""
    import random

    from papertrawl.functions import dom as D

    draw = random.Random(5)
    names = ["bx", "card", "pdp-price", "rating-block", "product-img", "b_algo", "b_ad", "b_caption", "my-supplier", "prod-name"]
    tags = ["div", "li", "ul", "h2", "h3", "a", "p", "span", "strong", "main", "article", "img", "section"]

    def page():
        out = []
        for _ in range(draw.randint(5, 40)):
            tag = draw.choice(tags)
            out.append(draw.choice(["</div>", "</ul>", "</article>", f'<{tag} class="{draw.choice(names)} {draw.choice(names)}">',
                                    f'<{tag} id="{draw.choice(["b_results", "x"])}" href="{draw.choice(["http://a", "/b"])}">', f"<{tag}>t"]))
        return "".join(out)

    pages = spark.createDataFrame([(i, page()) for i in range(60)], "id int, html string").select("id", D.parse_dom("html").alias("dom")).persist()
    wanted = ["#b_results > li:not(.b_ad)", ".pdp-price strong", "main article, main section", "div.rating-block span", "h2 a", "ul a[href^='/']",
              ".b_caption p, .b_snippet, p", "[class*='supplier']", ".product-img img", "li a", "div.bx", "a[href^='http']"]
    assert all(s in D.RULES for s in wanted)
    dom, seen = F.col("dom"), 0
    for selector in wanted:
        def both(tree):
            one = F.transform(D.select(tree, selector), lambda e: e["idx"])
            other = F.transform(F.filter(tree["elements"], lambda e: reduce(or_, [D._matches(tree, e, s) for s in selector.split(",")])), lambda e: e["idx"])
            return F.struct(one.alias("one"), other.alias("other"))
        trees = F.transform(F.slice(dom["elements"], 2, 12), lambda el: D.bind(D.subtree(dom, el), both))
        for r in pages.select(F.concat(F.array(both(dom)), trees).alias("found")).collect():
            for x in r.found:
                assert x.one == x.other, selector
                seen += len(x.one)
    assert seen > 500
