"""Product queries, over pages derived from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrawl.functions import text as T
from papertrawl.operators import products as P
from papertrawl.sources import rendered
from papertrawl.sources.tables import table


def _products(spark, sf):
    return P.extract_products(rendered.product_pages(spark, sf))


def product_catalog(spark, sf):
    return _products(spark, sf).select(
        "item", "platform", "product_id", "title", "price", "original_price", "discount", "currency", "rating",
        "review_count", "availability", "brand", "category", F.array_join("images", "|").alias("images"),
    )


def product_sources(spark, sf):
    """Which reading each product came from."""
    origin = F.coalesce(F.try_element_at("extra_meta", F.lit("source")), F.lit("page"))
    return _products(spark, sf).groupBy("platform", origin.alias("origin")).agg(F.count(F.lit(1)).alias("products"))


def rejected_platforms(spark, sf):
    pages = rendered.product_pages(spark, sf).withColumn(
        "platform", F.when(F.col("item") % 5 == 0, "ebay").otherwise(F.col("platform"))
    )
    return P.rejected_platforms(pages).select("item", "platform")


def platform_summary(spark, sf):
    return P.platform_summary(_products(spark, sf))


def price_analysis(spark, sf):
    return P.price_analysis(_products(spark, sf))


def product_report(spark, sf):
    return P.product_report_rows(_products(spark, sf))


def parse_price(spark, sf):
    """Price texts made from the numbers of every line item."""
    e = F.col("l_extendedprice")
    texts = F.array(
        F.concat(F.lit("₹"), F.format_number(e, 2)), F.concat(F.lit("Rs. "), e.cast("decimal(18,2)")),
        F.concat(F.lit("INR "), F.floor(e), F.lit(" only")), F.lit("free"),
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.posexplode(texts).alias("form", "raw")
    ).select("l_orderkey", "l_linenumber", "l_partkey", "form", T.price("raw").alias("price"),
             T.price("raw", strict_parity=True).alias("glued"))


def product_discount(spark, sf):
    """Discounts of every line item against its undiscounted price."""
    now = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2)
    return table(spark, sf, "lineitem").groupBy(
        T.discount(now, F.col("l_extendedprice")).alias("discount")
    ).agg(F.count(F.lit(1)).alias("lines"))


def availability(spark, sf):
    words = F.get(F.lit(["In Stock.", "Currently unavailable", "Only 2 left", "OUT OF STOCK"]),
                  F.pmod(F.col("p_partkey"), F.lit(4)).cast("int"))
    link = F.get(F.lit(["https://schema.org/InStock", "http://schema.org/OutOfStock", "x"]),
                 F.pmod(F.col("p_partkey"), F.lit(3)).cast("int"))
    return table(spark, sf, "part").select(
        "p_partkey", T.availability_from_text(words, F.lit(False)).alias("by_text"),
        T.availability_from_schema(link).alias("by_link"),
        T.clean_brand(F.concat(F.lit("Visit the "), F.col("p_brand"), F.lit(" Store"))).alias("brand"),
        T.rating(F.concat(F.col("p_size"), F.lit(".5 out of 5"))).alias("rating"),
        T.review_count(F.concat(F.format_number(F.col("p_partkey") * 10, 0), F.lit(" ratings"))).alias("reviews"),
        T.first_number(F.concat(F.lit("-"), F.col("p_size"), F.lit("% off"))).alias("percent"),
    )


def brand_assignment(spark, sf):
    names = F.lit(["nykaa", "meesho", "myntra", "snapdeal", "ajio", "bigbasket", "jiomart", "croma",
                   "reliance_digital", "tenth", "eleventh"])
    requests = table(spark, sf, "part").select(
        F.col("p_partkey").alias("job_id"),
        F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: F.concat(F.lit("u"), i)).alias("urls"),
        F.slice(names, F.lit(1), F.pmod(F.col("p_partkey"), F.lit(11)).cast("int") + 1).alias("brands"),
    )
    return P.assign_urls_to_brands(requests)


QUERIES = {f.__name__: f for f in (
    product_catalog, product_sources, rejected_platforms, platform_summary, price_analysis, product_report,
    parse_price, product_discount, availability, brand_assignment,
)}

_K = "p_partkey"
_BRANDS = "[" + ", ".join(f"'{b}'" for b, _ in rendered.BRAND_PAGES) + "]"
_BASE = f"""prod AS (SELECT {_K} AS item, k8, ['amazon','flipkart','amazon','flipkart','manual','flipkart','swiggy','zomato'][k8 + 1] AS platform,
    CASE WHEN k8 IN (0, 2) THEN 'B' || lpad({_K}::VARCHAR, 9, '0') WHEN k8 = 1 THEN 'P' || {_K} WHEN k8 = 3 THEN 'ITM' || {_K}
         WHEN k8 = 5 THEN 'F' || {_K} WHEN k8 = 6 THEN 'R' || {_K} END AS product_id,
    p_name || ' ' || {_K} AS title,
    CASE WHEN k8 < 6 THEN p_retailprice END AS price,
    CASE WHEN k8 IN (1, 2, 3, 5) THEN was END AS original_price,
    CASE WHEN k8 IN (1, 2, 3, 5) AND was > p_retailprice THEN round((was - p_retailprice) / was * 100, 1) END AS discount,
    'INR' AS currency, CASE WHEN k8 = 7 THEN stars + 0.5 ELSE stars END AS rating,
    CASE k8 WHEN 0 THEN p_size WHEN 2 THEN ('1' || p_size)::INT WHEN 3 THEN ('20' || p_size)::INT END AS review_count,
    CASE k8 WHEN 2 THEN 'out_of_stock' ELSE 'in_stock' END AS availability,
    CASE WHEN k8 < 4 OR k8 = 5 THEN p_brand WHEN k8 = 4 THEN ({_BRANDS})[{_K} // 8 % 9 + 1] ELSE p_name || ' ' || {_K} END AS brand,
    CASE WHEN k8 IN (2, 3) THEN 'Home > Tools' WHEN k8 > 5 THEN 'Restaurant' END AS category,
    CASE k8 WHEN 0 THEN 'a.jpg|b.jpg|c.jpg|d.jpg' WHEN 2 THEN 'h' || {_K} || '.jpg' WHEN 4 THEN 'm' || {_K} || '.jpg'
         WHEN 6 THEN 'img' || {_K} ELSE '' END AS images,
    'https://shop.example' || CASE WHEN k8 IN (0, 2) THEN '/dp/B' || lpad({_K}::VARCHAR, 9, '0') ELSE '/p/ITM' || {_K} END AS url
  FROM (SELECT *, {_K} % 8 AS k8, round(p_retailprice * 1.25, 2) AS was, (p_size % 5 + 1)::DOUBLE AS stars FROM part))"""
_AVG = "sum({0}::DECIMAL(18,2))::DOUBLE / count({0})"
_CAP = "upper({0}[1]) || {0}[2:]"

ORACLES = {
    "product_catalog": f"WITH {_BASE} SELECT * EXCLUDE (k8, url) FROM prod",
    "product_sources": f"""WITH {_BASE} SELECT platform, ['json_ld','preloaded_state','page','dom','page','flipkart_api','page','page'][k8 + 1] AS origin,
        count(*) AS products FROM prod GROUP BY ALL""",
    "rejected_platforms": f"SELECT {_K} AS item, 'ebay' AS platform FROM part WHERE {_K} % 5 = 0",
    "platform_summary": f"""WITH {_BASE} SELECT {_CAP.format('platform')} AS platform, count(*) AS products,
        count(price) AS with_price, {_AVG.format('price')} AS avg_price, count(rating) AS with_rating,
        {_AVG.format('rating')} AS avg_rating FROM prod GROUP BY platform
        UNION ALL SELECT 'Total', count(*), NULL, NULL, NULL, NULL FROM part""",
    "price_analysis": f"""WITH {_BASE} SELECT {_CAP.format('platform')} AS platform, min(price) AS min_price,
        max(price) AS max_price, {_AVG.format('price')} AS avg_price, max(discount) AS max_discount,
        {_AVG.format('discount')} AS avg_discount, count(*) FILTER (availability LIKE '%out%') AS out_of_stock
        FROM prod GROUP BY platform""",
    "product_report": f"""WITH {_BASE} SELECT {_CAP.format('platform')} AS platform, left(title, 200) AS title,
        coalesce(brand, '') AS brand, coalesce(category, '') AS category,
        coalesce('₹' || format('{{:,.2f}}', price), '') AS price,
        coalesce('₹' || format('{{:,.2f}}', original_price), '') AS original_price,
        coalesce(format('{{:.1f}}', discount) || '%', '') AS discount, format('{{:.1f}}', rating) AS rating,
        coalesce(CASE WHEN review_count <> 0 THEN review_count::VARCHAR END, '') AS review_count,
        CASE availability WHEN 'in_stock' THEN 'In stock' ELSE 'Out of stock' END AS availability,
        coalesce(product_id, '') AS product_id, url, '' AS scraped_at FROM prod""",
    "parse_price": """SELECT l_orderkey, l_linenumber, l_partkey, form,
        CASE form WHEN 0 THEN e WHEN 1 THEN e WHEN 2 THEN floor(e) END AS price,
        CASE form WHEN 0 THEN e WHEN 2 THEN floor(e) END AS glued
        FROM (SELECT *, l_extendedprice AS e FROM lineitem), range(4) r(form)
        WHERE form <> 1
        UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 1, l_extendedprice, NULL FROM lineitem""",
    "product_discount": """SELECT CASE WHEN n > 0 AND l_extendedprice > n
        THEN round((l_extendedprice - n) / l_extendedprice * 100, 1) END AS discount, count(*) AS lines
        FROM (SELECT *, round(l_extendedprice * (1 - l_discount), 2) AS n FROM lineitem) GROUP BY ALL""",
    "availability": f"""SELECT {_K}, ['in_stock', 'out_of_stock', 'limited', 'out_of_stock'][{_K} % 4 + 1] AS by_text,
        ['in_stock', 'out_of_stock', 'limited'][{_K} % 3 + 1] AS by_link, p_brand AS brand,
        CASE WHEN p_size + 0.5 <= 5 THEN (p_size + 0.5)::DOUBLE END AS rating, ({_K} * 10)::INT AS reviews,
        p_size::DOUBLE AS percent FROM part""",
    "brand_assignment": f"""WITH j AS (SELECT {_K} AS job_id, p_size AS n, {_K} % 11 + 1 AS b,
        ['nykaa','meesho','myntra','snapdeal','ajio','bigbasket','jiomart','croma','reliance_digital','tenth','eleventh'] AS names FROM part),
        s AS (SELECT job_id, n, names[i + 1] AS brand, i, greatest(1, n // b) AS per, b FROM j, range(11) r(i) WHERE i < b)
      SELECT job_id, brand, 'u' || u AS url FROM s, range(1, 51) v(u)
      WHERE u <= n AND ((u > i * per AND (u <= (i + 1) * per OR i = b - 1)) OR i * per >= n)""",
}
