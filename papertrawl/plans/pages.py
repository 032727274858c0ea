"""Page element queries and the functions callable from SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrawl.functions import dom as D
from papertrawl.functions.registry import register
from papertrawl.sources.tables import spread, table


def _pages(spark, sf):
    return spread(table(spark, sf, "pages")).select("page_id", D.parse_dom("html").alias("dom"))


def html_elements(spark, sf):
    """Elements of every page by tag."""
    el = _pages(spark, sf).select("page_id", F.inline("dom.elements"))
    return el.filter("idx > 0").groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("elements"))


def page_titles(spark, sf):
    dom = F.col("dom")
    return _pages(spark, sf).select(
        "page_id", D.first_text(dom, ["title"]).alias("title"), D.first_text(dom, ["h1"]).alias("heading")
    )


def page_links(spark, sf):
    """Links inside lists, in order."""
    dom = F.col("dom")
    links = F.transform(D.select(dom, "ul a[href^='/']"), lambda a: F.struct(
        D.attr(a, "href").alias("href"), D.text_of(dom, a, "").alias("label")
    ))
    return _pages(spark, sf).select("page_id", F.posexplode(links).alias("pos", "link")).select("page_id", "pos", "link.*")


def sql_functions(spark, sf):
    """The SQL forms over customers."""
    register(spark)
    table(spark, sf, "customer").createOrReplaceTempView("papertrawl_customer")
    return spark.sql("""
        SELECT c_custkey, parse_num(concat('Rs ', c_acctbal)) AS balance, dedup_key(c_name, c_mktsegment) AS dedup_key,
               quality_score('', c_name, NULL, 'x', '') AS score,
               round(cosine_similarity(array(1D, c_custkey), array(0D, 1D)), 6) AS similarity
        FROM papertrawl_customer""")


def sql_chunks(spark, sf):
    register(spark)
    spread(table(spark, sf, "documents")).createOrReplaceTempView("papertrawl_documents")
    return spark.sql("""
        SELECT doc_id, count(*) AS chunks, max(length(c.text)) AS longest
        FROM papertrawl_documents d, LATERAL chunk_text(d.text, 512, 128) c GROUP BY doc_id""")


def sql_elements(spark, sf):
    register(spark)
    spread(table(spark, sf, "pages")).createOrReplaceTempView("papertrawl_pages")
    return spark.sql("""
        SELECT page_id, e.tag, count(*) AS elements
        FROM papertrawl_pages p, LATERAL html_elements(p.html) e GROUP BY page_id, e.tag""")


QUERIES = {f.__name__: f for f in (html_elements, page_titles, page_links, sql_functions, sql_chunks, sql_elements)}

_TITLE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<{0}>(.*?)</{0}>', 1), '&amp;', '&', 'g'), '&lt;', '<', 'g'), '&gt;', '>', 'g'))"
_TAGS = """SELECT page_id, tag, count(*) AS elements FROM (
    SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY ALL"""
ORACLES = {
    "html_elements": _TAGS,
    "sql_elements": _TAGS,
    "page_titles": f"SELECT page_id, {_TITLE.format('title')} AS title, {_TITLE.format('h1')} AS heading FROM pages",
    "page_links": r"""SELECT page_id, i - 1 AS pos, regexp_extract(l[i], 'href="([^"]*)"', 1) AS href, regexp_extract(l[i], '">([^<]*)<', 1) AS label
      FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="/[^"]*">[^<]*</a>', 0) AS l FROM pages), range(1, 2000) r(i) WHERE i <= len(l)""",
    "sql_functions": r"""SELECT c_custkey, round(abs(c_acctbal), 2) AS balance,
        md5(left(regexp_replace(lower(c_name), '[^\pL\pN_]+', '', 'g'), 40) || ':' || lower(c_mktsegment)) AS dedup_key, 4 AS score,
        round(c_custkey / sqrt(1.0 + c_custkey::DOUBLE * c_custkey), 6) AS similarity FROM customer""",
}
from papertrawl.plans.retrieval import ORACLES as _CHUNKS  # noqa: E402

ORACLES["sql_chunks"] = _CHUNKS["chunk_stats"]
