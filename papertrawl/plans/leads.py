"""Lead queries, over listings derived from customers and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrawl import fixed_values as fv
from papertrawl.functions import contacts as C
from papertrawl.functions import text as T
from papertrawl.operators import lead_reports as R
from papertrawl.operators import leads as L
from papertrawl.operators import ranking
from papertrawl.session import cut_lineage, scratch_path
from papertrawl.sources import rendered, sinks, tables
from papertrawl.sources.tables import spread, table

KEY = ["source", "item"]
#: Limits of the three requests of lead_jobs.
JOB_LIMITS = (40, 300, 5000)


def _leads(spark, sf):
    return L.score_leads(L.dedup_leads(rendered.lead_listings(spark, sf)))


def _contacts(spark, sf):
    return L.site_contacts(rendered.contact_pages(spark, sf), tables.contact_paths(spark))


def lead_dedup(spark, sf):
    return L.dedup_leads(rendered.lead_listings(spark, sf)).select(*KEY, "company_name", "city", "dedup_key", "phone")


def lead_cap(spark, sf):
    return L.cap_leads(L.dedup_leads(rendered.lead_listings(spark, sf)), 500).select(*KEY, "company_name")


def lead_quality(spark, sf):
    return _leads(spark, sf).select(
        *KEY, C.has_contact().alias("has_contact"), "quality_score", "confidence_score",
        R.confidence_tier("confidence_score").alias("tier"),
    )


def site_contacts(spark, sf):
    return _contacts(spark, sf)


def lead_enrich(spark, sf):
    enriched = L.enrich_leads(L.dedup_leads(rendered.lead_listings(spark, sf)), _contacts(spark, sf))
    return enriched.select(*KEY, "phone", "email", "address", "was_enriched")


def lead_directory(spark, sf):
    leads = L.lead_directory(rendered.lead_listings(spark, sf), _contacts(spark, sf))
    return leads.select(*KEY, "company_name", "phone", "email", "quality_score", "confidence_score")


def lead_jobs(spark, sf):
    """Three jobs over the sources, each with its own limit; a firm listed in two jobs is a lead of both."""
    listings = rendered.lead_listings(spark, sf).withColumn("job_id", (F.col("task") + F.col("source_rank")) % 3)
    limits = F.get(F.array(*[F.lit(n) for n in JOB_LIMITS]), F.col("job_id"))
    leads = L.lead_directory(listings.withColumn("max_leads", limits), _contacts(spark, sf), "max_leads", ["job_id"])
    return leads.select("job_id", *KEY, "company_name", "phone", "email", "was_enriched", "quality_score")


#: Three jobs: categories, places, queries, sources, lead limit.
LEAD_JOBS = [
    (1, [], [], [], ["indiamart", "bing", "sulekha", "justdial"], 5000),
    (2, ["trader", "ca_firm", "logistics"], [" pune", "KOLKATA ", "Mumbai"], ["MACHINERY", " "], ["bing", "sulekha"], 40),
    (3, ["unknown"], ["mumbai", "Surat"], [], ["indiamart", "justdial"], 300),
]


def lead_pipeline(spark, sf):
    """Three jobs from their requests and the fetched pages to stored leads, the third one run twice."""
    requests = spark.createDataFrame(LEAD_JOBS, "request_id bigint, categories array<string>, locations array<string>, "
                                     "search_queries array<string>, sources array<string>, max_leads int")
    path = scratch_path(spark, "leads")
    pages = rendered.fetched_pages(spark, sf)
    leads = cut_lineage(L.lead_pipeline(requests, pages, rendered.linked_firm_pages(spark, sf), _contacts(spark, sf)), "job-leads")
    sinks.write_leads(leads, path, requests.select(F.col("request_id").alias("job_id")))
    sinks.write_leads(leads.filter("job_id = 3"), path)
    stored = spark.read.schema(leads.schema).parquet(path)
    return stored.select("job_id", "source", "company_name", "category", "city", "phone", "email", "website", "address",
                         "was_enriched", "quality_score")


def blocked_pages(spark, sf):
    """Result pages to fetch again, by reason."""
    pages = rendered.fetched_pages(spark, sf).filter("source = 'bing'").select("url", "html")
    short = rendered.serp_pages(spark, sf).select(F.col("page_id").cast("string").alias("url"), "html")
    return L.blocked_pages(pages.unionByName(short)).select("url", "reason")


def rejected_requests(spark, sf):
    requests = _requests(spark, sf).withColumn("urls", F.when(F.col("request_id") % 2 == 0, F.sequence(
        F.lit(1), F.pmod("request_id", F.lit(60)))))
    return L.rejected_requests(requests).select("request_id", "reason")


def enrichment_stats(spark, sf):
    return L.enrichment_stats(
        L.enrich_leads(L.dedup_leads(rendered.lead_listings(spark, sf)), _contacts(spark, sf))
    )


def lead_coverage(spark, sf):
    return R.coverage(_leads(spark, sf))


def lead_counts(spark, sf):
    return R.counts_by_dim(_leads(spark, sf))


def lead_sorted_counts(spark, sf):
    return R.sort_counts(R.counts_by_dim(_leads(spark, sf)))


def lead_dims(spark, sf):
    return L.lookup_dims(_leads(spark, sf)).select(*KEY, "region", "category_label", "segment_label")


def segment_summary(spark, sf):
    return R.segment_summary(_leads(spark, sf))


def segment_keys(spark, sf):
    by_market = rendered.lead_listings(spark, sf).withColumn(
        "category", F.when(F.col("source") == "sulekha", "supplier").otherwise(F.col("category"))
    )
    return R.segment_keys(by_market)


def high_priority(spark, sf):
    return R.high_priority(_leads(spark, sf)).select(*KEY, "company_name", "confidence_score")


def high_priority_fallback(spark, sf):
    return R.high_priority(_leads(spark, sf).withColumn("phone", F.lit(""))).select(*KEY, "confidence_score")


def lead_filters(spark, sf):
    return R.filter_leads(
        _leads(spark, sf), category="trader", with_phone=True, with_email=True, city_contains="AI"
    ).select(*KEY, "city", "phone", "email")


def lead_page(spark, sf):
    ordered = [F.desc_nulls_last("quality_score"), F.asc("source_rank"), F.asc("task"), F.asc("item")]
    return ranking.page(_leads(spark, sf), ordered, 3, 100).select(*KEY, "quality_score")


def lead_page_envelope(spark, sf):
    return ranking.page_envelope(R.filter_leads(_leads(spark, sf), with_phone=True), 1, 100)


def lead_report(spark, sf):
    return R.lead_report_rows(_leads(spark, sf))


def lead_numbers(spark, sf):
    """Row numbers within each segment's sheet."""
    numbered = ranking.number_rows(
        _leads(spark, sf).select("category", "source_rank", "task", "item"), ["category"],
        ["source_rank", "task", "item"], "lead_no",
    )
    return numbered


def lead_storage_rows(spark, sf):
    rows = R.lead_to_product_row(_leads(spark, sf), "job-1")
    return rows.select(
        "title", "brand", "platform", "url", "rating", "description",
        F.col("extra_meta")["phone"].alias("phone"), F.col("extra_meta")["city"].alias("city"),
    )


def lead_view(spark, sf):
    view = R.lead_view(rendered.stored_products(spark, sf))
    return view.select(
        "id", "company_name", "category", "city", "phone", "website", "source_platform", "source_url",
        "confidence_score", F.array_join("services", "|").alias("services"),
        F.array_join(F.map_keys("extra_meta"), ",").alias("other_keys"),
    )


def lead_export(spark, sf):
    view = R.lead_export(R.lead_view(rendered.stored_products(spark, sf)))
    return view.select("id", "company_name", "services", "confidence_score")


def _requests(spark, sf):
    k = F.col("c_custkey")
    ids = F.lit([c[0] for c in fv.CATEGORIES] + ["unknown"])
    names = F.lit(["  new delhi ", "mumbai", " ", "CHENNAI"])
    return table(spark, sf, "customer").select(
        k.alias("request_id"),
        F.array(F.get(ids, F.pmod(k, F.lit(18)).cast("int"))).alias("categories"),
        F.when(k % 4 == 2, F.array().cast("array<string>")).otherwise(
            F.array(F.get(names, F.pmod(k, F.lit(4)).cast("int")))
        ).alias("locations"),
        F.array(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" ")), F.lit("  ")).alias("search_queries"),
        F.when(k % 2 == 0, F.array(F.lit("indiamart"), F.lit("bing"))).otherwise(
            F.array(F.lit("sulekha"), F.lit("justdial"), F.lit("bing"))
        ).alias("sources"),
        F.pmod(k * 7, F.lit(6000)).cast("int").alias("max_leads"),
    )


def clean_requests(spark, sf):
    return L.clean_requests(_requests(spark, sf)).select(
        "request_id", F.array_join("search_queries", "|").alias("queries"),
        F.array_join("locations", "|").alias("places"), "max_leads",
    )


def request_grid(spark, sf):
    return L.request_grid(L.clean_requests(_requests(spark, sf))).drop("task")


def known_categories(spark, sf):
    """Categories that customers' requests name; all when none is known."""
    wanted = _requests(spark, sf).select(F.explode("categories").alias("category"))
    return L.restrict_categories(tables.categories(spark), wanted).select("category", "label")


def wanted_categories(spark, sf):
    """Known categories among those that some requests name, and all of them where requests name only unknown ones."""
    asked = _requests(spark, sf).select((F.col("request_id") % 18).alias("kind"), F.explode("categories").alias("category"))
    dim = tables.categories(spark)
    some = L.restrict_categories(dim, asked.filter(F.col("kind").isin(2, 5, 17)))
    none = L.restrict_categories(dim, asked.filter(F.col("kind") == 17))
    return some.select(F.lit("some known").alias("requests"), "category").unionByName(
        none.select(F.lit("none known").alias("requests"), "category"))


def gated_sources(spark, sf):
    return L.gate_sources(rendered.lead_listings(spark, sf), ["bing", "sulekha"]).groupBy("source").agg(
        F.count(F.lit(1)).alias("leads")
    )


def listing_cards(spark, sf):
    return L.leads_from_cards(rendered.listing_pages(spark, sf)).select(
        "page_id", "item", "company_name", "phone", "email", "website", "address", "source"
    )


def heading_leads(spark, sf):
    return L.leads_from_headings(rendered.heading_pages(spark, sf)).select(
        "page_id", "item", "company_name", "phone", "email"
    )


def service_cards(spark, sf):
    return L.leads_from_services(rendered.service_pages(spark, sf)).select(
        "page_id", "item", "company_name", "phone", "email", "address"
    )


def serp_leads(spark, sf):
    pages = L.reject_bot_pages(rendered.serp_pages(spark, sf))
    return L.leads_from_serp(pages).select("page_id", "item", "company_name", "phone", "website")


def serp_links(spark, sf):
    """Pages without result items: their links to outside hosts."""
    return L.leads_from_serp(rendered.link_pages(spark, sf)).select("page_id", "item", "company_name", "website")


def site_search_urls(spark, sf):
    return L.search_result_urls(rendered.serp_pages(spark, sf)).select("page_id", "item", "url")


def site_search_leads(spark, sf):
    """Search pages joined to the pages they link to."""
    return L.leads_from_site_search(rendered.serp_pages(spark, sf), rendered.linked_pages(spark, sf)).select(
        "url", "task", "company_name", "phone", "website", "source"
    )


def sorted_cities(spark, sf):
    """Cities by label with the number of listings in them."""
    counts = rendered.lead_listings(spark, sf).groupBy("city").agg(F.count(F.lit(1)).alias("listings"))
    return tables.cities(spark).join(counts, "city", "left").select("city", "region", "listings").orderBy("city")


def business_page_leads(spark, sf):
    pages = spread(table(spark, sf, "pages")).select(
        "page_id", "url", "html", F.lit("importer").alias("category"), F.lit("Mumbai").alias("city")
    )
    return L.lead_from_page(pages, "justdial").select("page_id", "company_name", "phone", "email", "website")


QUERIES = {f.__name__: f for f in (
    lead_dedup, lead_cap, lead_quality, site_contacts, lead_enrich, lead_directory, lead_jobs, lead_pipeline, blocked_pages,
    rejected_requests, enrichment_stats, lead_coverage,
    lead_counts, lead_sorted_counts, lead_dims, segment_summary, segment_keys, high_priority,
    high_priority_fallback, lead_filters, lead_page, lead_page_envelope, lead_report, lead_numbers,
    lead_storage_rows, lead_view, lead_export, clean_requests, request_grid, known_categories, wanted_categories, gated_sources,
    listing_cards, heading_leads, service_cards, serp_leads, serp_links, site_search_urls, site_search_leads,
    sorted_cities, business_page_leads,
)}

# ---- the same in DuckDB ---------------------------------------------------------------------------


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_map(pairs) -> str:
    return f"MAP({sql_list([a for a, _ in pairs])}, {sql_list([b for _, b in pairs])})"


_CATS, _CITIES = sql_list([c[0] for c in fv.CATEGORIES]), sql_list([c[0] for c in fv.CITIES])


def _listing_sql(source, rank, key, name, nation, note, always, table_name, where="true"):
    digits = f"lpad({key}::VARCHAR, 9, '0')"
    city = f"({_CITIES})[({nation} % 15) + 1]"
    return f"""SELECT '{source}' AS source, {rank} AS source_rank, {nation} AS task, {key} AS item,
      {name} AS company_name, ({_CATS})[({key} % 17) + 1] AS category, {city} AS city,
      CASE WHEN {always} OR {key} % 2 = 0 THEN '9' || {digits} ELSE '' END AS phone,
      CASE WHEN {key} % 5 = 0 THEN '8' || {digits} ELSE '' END AS mobile,
      CASE WHEN {key} % 3 = 1 THEN 'sales' || {key} || '@firm.in' ELSE '' END AS email,
      CASE WHEN {key} % 4 <> 3 THEN 'https://www.firm' || {key} || '.in/home' ELSE '' END AS website,
      CASE WHEN {key} % 7 = 0 THEN 'Plot ' || {key} || ', ' || {city} ELSE '' END AS address,
      {note} AS description FROM {table_name} WHERE {where}"""


_BASE = f"""listings AS (
  {_listing_sql('indiamart', 0, 'c_custkey', 'c_name', 'c_nationkey', "c_mktsegment || ' trade'", 'false', 'customer')}
  UNION ALL {_listing_sql('bing', 1, 'c_custkey', "upper(replace(c_name, '#', ' '))", 'c_nationkey', "c_mktsegment || ' trade'", 'true', 'customer', "c_mktsegment IN ('MACHINERY', 'FURNITURE')")}
  UNION ALL {_listing_sql('sulekha', 2, 's_suppkey', 's_name', 's_nationkey', "'supplier'", 'false', 'supplier')}),
keyed AS (SELECT *, md5(left(regexp_replace(lower(company_name), '[^\\pL\\pN_]+', '', 'g'), 40) || ':' || lower(city)) AS dedup_key
          FROM listings WHERE length(company_name) >= 3),
deduped AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY source_rank, task, item) = 1),
scored AS (SELECT *, q AS quality_score, least(round(q / 8.0, 3), 1.0)::DOUBLE AS confidence_score FROM (
  SELECT *, CASE WHEN phone <> '' OR mobile <> '' THEN 3 ELSE 0 END + CASE WHEN email <> '' THEN 3 ELSE 0 END
          + CASE WHEN website <> '' THEN 1 ELSE 0 END + CASE WHEN address <> '' THEN 1 ELSE 0 END AS q FROM deduped)),
sites AS (SELECT 'https://www.firm' || c_custkey || '.in' AS site,
    CASE WHEN c_custkey % 9 = 3 THEN '7' || lpad(c_custkey::VARCHAR, 9, '0') ELSE '6' || lpad(c_custkey::VARCHAR, 9, '0') END AS site_phone,
    CASE WHEN c_custkey % 27 = 3 THEN 'desk' || c_custkey || '@firm.in' ELSE 'home' || c_custkey || '@firm.in' END AS site_email,
    CASE WHEN c_custkey % 27 = 3 THEN NULL ELSE 'About ' || c_custkey END AS site_address FROM customer),
enriched AS (SELECT d.* EXCLUDE (phone, email, address),
    coalesce(nullif(phone, ''), site_phone, '') AS phone, coalesce(nullif(email, ''), site_email, '') AS email,
    coalesce(nullif(address, ''), site_address, '') AS address, site IS NOT NULL AS was_enriched
  FROM deduped d LEFT JOIN sites ON website <> '' AND phone = '' AND mobile = '' AND email = ''
   AND site = replace(website, '/home', ''))"""
_SEG = sql_map(fv.SEGMENT_LABELS)
_REQ = f"""requests AS (SELECT c_custkey AS request_id,
    ({sql_list([c[0] for c in fv.CATEGORIES] + ['unknown'])})[(c_custkey % 18) + 1] AS category,
    CASE c_custkey % 4 WHEN 0 THEN 'New Delhi' WHEN 1 THEN 'Mumbai' WHEN 3 THEN 'Chennai' END AS place,
    c_mktsegment AS query, (c_custkey * 7) % 6000 AS max_leads, c_custkey % 2 AS odd FROM customer
    WHERE (c_custkey * 7) % 6000 BETWEEN 1 AND 5000)"""
_DIM = "dim AS (SELECT * FROM (VALUES " + ", ".join(
    "({}, {}, {}, {}, {})".format(
        f"'{i}'", f"'{label}'", f"'{kw[0]}'", f"'{term}'", f"'{slug}'" if slug else "NULL"
    ) for i, label, kw, term, slug in fv.CATEGORIES
) + ") AS t(category, label, kw, term, slug))"
_ENC = "replace(url_encode({}), '%20', '+')"
_SLUGS = sql_map(list(fv.SERVICES_CITY_SLUGS.items()))


def _with(select: str) -> str:
    return f"WITH {_BASE} {select}"


_WORDY = "regexp_replace({}, '[^0-9]', '', 'g')"
ORACLES = {
    "lead_dedup": _with("SELECT source, item, company_name, city, dedup_key, phone FROM deduped"),
    "lead_cap": _with("SELECT source, item, company_name FROM deduped ORDER BY source_rank, task, item LIMIT 500"),
    "lead_quality": _with("""SELECT source, item, phone <> '' OR mobile <> '' OR email <> '' AS has_contact,
        quality_score, confidence_score, CASE WHEN confidence_score >= 0.7 THEN 'high'
        WHEN confidence_score >= 0.4 THEN 'medium' ELSE 'low' END AS tier FROM scored"""),
    "site_contacts": _with("SELECT * FROM sites"),
    "lead_enrich": _with("SELECT source, item, phone, email, address, was_enriched FROM enriched"),
    "lead_directory": _with("""SELECT source, item, company_name, phone, email, q AS quality_score,
        least(round(q / 8.0, 3), 1.0)::DOUBLE AS confidence_score FROM (
        SELECT *, CASE WHEN phone <> '' OR mobile <> '' THEN 3 ELSE 0 END + CASE WHEN email <> '' THEN 3 ELSE 0 END
          + CASE WHEN website <> '' THEN 1 ELSE 0 END + CASE WHEN address <> '' THEN 1 ELSE 0 END AS q FROM enriched)"""),
    "lead_jobs": _with(f"""SELECT job_id, source, item, company_name, p AS phone, e AS email, was_enriched,
        CASE WHEN p <> '' OR mobile <> '' THEN 3 ELSE 0 END + CASE WHEN e <> '' THEN 3 ELSE 0 END
          + CASE WHEN website <> '' THEN 1 ELSE 0 END + CASE WHEN a <> '' THEN 1 ELSE 0 END AS quality_score
      FROM (SELECT *, coalesce(nullif(phone, ''), site_phone, '') AS p, coalesce(nullif(email, ''), site_email, '') AS e,
          coalesce(nullif(address, ''), site_address, '') AS a, site IS NOT NULL AS was_enriched
        FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY source_rank, task, item) AS place FROM (
          SELECT *, (task + source_rank) % 3 AS job_id FROM keyed
          QUALIFY row_number() OVER (PARTITION BY (task + source_rank) % 3, dedup_key ORDER BY source_rank, task, item) = 1)) d
        LEFT JOIN sites ON website <> '' AND phone = '' AND mobile = '' AND email = '' AND site = replace(website, '/home', '')
        WHERE place <= [{', '.join(map(str, JOB_LIMITS))}][job_id + 1])"""),
    "enrichment_stats": _with("""SELECT source, count(*) AS leads,
        count(*) FILTER (was_enriched AND phone <> '') AS enriched_phone,
        count(*) FILTER (was_enriched AND email <> '') AS enriched_email FROM enriched GROUP BY source"""),
    "lead_coverage": _with("""SELECT count(*) AS total_leads, count(*) FILTER (phone <> '' OR mobile <> '') AS with_phone,
        count(*) FILTER (email <> '') AS with_email, count(*) FILTER (website <> '') AS with_website,
        count(*) FILTER ((phone <> '' OR mobile <> '') AND email <> '') AS phone_and_email FROM scored"""),
    "lead_counts": _with("""SELECT 'city' AS dim, city AS key, count(*) AS leads FROM scored GROUP BY city
        UNION ALL SELECT 'category', category, count(*) FROM scored GROUP BY category
        UNION ALL SELECT 'source', source, count(*) FROM scored GROUP BY source"""),
    "lead_dims": _with(f"""SELECT source, item, {sql_map([(c, r) for c, r in fv.CITIES])}[city] AS region,
        {sql_map([(c[0], c[1]) for c in fv.CATEGORIES])}[category] AS category_label,
        {_SEG}[category] AS segment_label FROM scored"""),
    "segment_summary": _with(f"""SELECT coalesce({_SEG}[category], 'TOTAL') AS segment, count(*) AS leads,
        count(*) FILTER (phone <> '') AS with_phone, count(*) FILTER (email <> '') AS with_email,
        count(*) FILTER (website <> '') AS with_website, count(DISTINCT city) AS cities,
        CASE WHEN category IS NULL THEN '' ELSE
          round(sum(confidence_score::DECIMAL(10,3))::DOUBLE / count(*) * 100)::INT || '%' END AS avg_conf
        FROM scored GROUP BY ROLLUP (category)"""),
    "segment_keys": _with("SELECT DISTINCT place, segment FROM (SELECT unnest(range(17)) AS place, unnest("
                          + sql_list([s for s, _ in fv.SEGMENT_LABELS])
                          + ") AS segment UNION ALL SELECT 17, 'supplier' FROM listings WHERE source = 'sulekha')"),
    "high_priority": _with("""SELECT source, item, company_name, confidence_score FROM scored
        WHERE phone <> '' AND (email <> '' OR website <> '')"""),
    "high_priority_fallback": _with("""SELECT source, item, confidence_score FROM scored
        ORDER BY confidence_score DESC, source_rank, task, item LIMIT 50"""),
    "lead_filters": _with("""SELECT source, item, city, phone, email FROM scored WHERE category = 'trader'
        AND length(phone) >= 7 AND email LIKE '%@%' AND contains(lower(city), 'ai')"""),
    "lead_page": _with("""SELECT source, item, quality_score FROM scored
        ORDER BY quality_score DESC, source_rank, task, item LIMIT 100 OFFSET 200"""),
    "lead_page_envelope": _with("""SELECT count(*) AS total, 1 AS page, 100 AS per_page,
        ceil(count(*) / 100)::BIGINT AS total_pages FROM scored WHERE length(phone) >= 7"""),
    "lead_report": _with("""SELECT company_name, phone, mobile, email, website, address, category, city,
        upper(source[1]) || source[2:] AS source,
        CASE WHEN phone <> '' OR mobile <> '' THEN 'Yes' ELSE 'No' END AS has_phone,
        CASE WHEN email <> '' THEN 'Yes' ELSE 'No' END AS has_email, quality_score,
        floor(confidence_score * 100)::INT || '%' AS conf, CASE WHEN confidence_score >= 0.7 THEN 'high'
        WHEN confidence_score >= 0.4 THEN 'medium' ELSE 'low' END AS tier, left(description, 200) AS description FROM scored"""),
    "lead_numbers": _with("""SELECT category, source_rank, task, item,
        row_number() OVER (PARTITION BY category ORDER BY source_rank, task, item) AS lead_no FROM scored"""),
    "lead_storage_rows": _with("""SELECT left(company_name, 200) AS title, left(category, 100) AS brand,
        left(source, 100) AS platform, left(website, 500) AS url, quality_score::DOUBLE AS rating,
        left(description, 500) AS description, phone, city FROM scored"""),
    "lead_view": """SELECT c_custkey::VARCHAR AS id, c_name AS company_name,
        CASE WHEN c_custkey % 5 <> 0 THEN 'trader' ELSE 'other' END AS category, c_mktsegment AS city,
        CASE WHEN c_custkey % 2 = 0 THEN '9' ELSE '8' END || lpad(c_custkey::VARCHAR, 9, '0') AS phone,
        'http://c' || c_custkey AS website, 'indiamart' AS source_platform,
        CASE WHEN c_custkey % 3 = 0 THEN 'http://s' ELSE 'http://c' || c_custkey END AS source_url,
        least(round((c_custkey % 11) / 8.0, 3), 1.0)::DOUBLE AS confidence_score, 'audit|tax|filing' AS services,
        'rank' AS other_keys FROM customer""",
    "lead_export": """SELECT c_custkey::VARCHAR AS id, c_name AS company_name, 'audit, tax, filing' AS services,
        least(round((c_custkey % 11) / 8.0, 3), 1.0)::DOUBLE AS confidence_score FROM customer""",
    "clean_requests": f"""WITH {_REQ} SELECT request_id, query AS queries, coalesce(place, '') AS places, max_leads FROM requests""",
    "request_grid": f"""WITH {_REQ}, {_DIM},
      base AS (SELECT request_id, odd, query, category, unnest(CASE WHEN place IS NULL
          THEN {sql_list(fv.DEFAULT_CITIES)} ELSE [place] END) AS city FROM requests),
      grid AS (SELECT b.request_id, odd, city, d.* FROM base b JOIN dim d
          ON d.category = b.category OR b.category = 'unknown')
      SELECT request_id, category, city, 'indiamart' AS source, term AS search_text,
        'https://dir.indiamart.com/search.mp?ss=' || {_ENC.format('term')} || '&City=' || {_ENC.format('city')} || '&catids=&bcat=' AS url
      FROM grid WHERE odd = 0
      UNION ALL SELECT request_id, category, city, 'bing', kw || ' ' || city || ' India contact phone',
        'https://www.bing.com/search?q=' || {_ENC.format("kw || ' ' || city || ' India contact phone'")} || '&count=10&mkt=en-IN&setlang=en-IN&cc=IN' FROM grid
      UNION ALL SELECT request_id, category, city, 'sulekha', slug,
        'https://www.sulekha.com/' || slug || '/' || coalesce({_SLUGS}[city], lower(city)) || '-service-providers'
      FROM grid WHERE odd = 1 AND slug IS NOT NULL
      UNION ALL SELECT request_id, category, city, 'justdial', t,
        'https://www.bing.com/search?q=' || {_ENC.format('t')} || '&count=8&mkt=en-IN'
      FROM (SELECT *, 'site:justdial.com ' || array_to_string(string_split(kw, ' ')[1:3], ' ') || ' ' || city AS t FROM grid WHERE odd = 1)
      UNION ALL SELECT request_id, 'Custom', city, 'bing', t,
        'https://www.bing.com/search?q=' || {_ENC.format('t')} || '&count=10&mkt=en-IN&setlang=en-IN&cc=IN'
      FROM (SELECT *, query || ' ' || city || ' India' AS t FROM base)""",
    "known_categories": f"""WITH {_DIM} SELECT category, label FROM dim""",
    "wanted_categories": f"""WITH {_DIM}, c AS (SELECT unnest({_CATS}) AS category, unnest(range(17)) AS n)
      SELECT 'some known' AS requests, category FROM c WHERE n IN (2, 5) UNION ALL SELECT 'none known', category FROM dim""",
    "gated_sources": _with("SELECT source, count(*) AS leads FROM listings WHERE source IN ('bing', 'sulekha') GROUP BY source"),
    "listing_cards": """
      WITH c AS (SELECT *, lpad(c_custkey::VARCHAR, 9, '0') AS d,
        translate(c_custkey::VARCHAR, '0123456789', 'abcdefghij') AS w FROM customer)
      SELECT c_custkey AS page_id, 0 AS item, c_name AS company_name, '9' || d AS phone,
        'card' || c_custkey || '@firm.in' AS email, 'https://firm' || c_custkey || '.in' AS website,
        'Road ' || c_custkey AS address, 'indiamart' AS source FROM c WHERE c_custkey % 4 <> 3
      UNION ALL SELECT c_custkey, 0, 'Heading Firm ' || w, '7' || d, '', '', '', 'indiamart_regex' FROM c WHERE c_custkey % 4 = 3
      UNION ALL SELECT c_custkey, 1, 'Second House ' || w, '', '', '', '', 'indiamart_regex' FROM c WHERE c_custkey % 4 = 3""",
    "serp_leads": """SELECT s_suppkey AS page_id, 0 AS item, s_name AS company_name,
        '98765' || lpad(s_suppkey::VARCHAR, 5, '0') AS phone, 'https://shop' || s_suppkey || '.in/a' AS website
      FROM supplier WHERE s_suppkey % 3 <> 2""",
    "site_search_urls": """SELECT s_suppkey AS page_id, i AS item,
        'https://www.justdial.com/' || ['one', 'two'][i + 1] || s_suppkey AS url FROM supplier, range(2) r(i)""",
}
ORACLES["heading_leads"] = """
  WITH c AS (SELECT c_custkey AS page_id, lpad(c_custkey::VARCHAR, 9, '0') AS d, translate(c_custkey::VARCHAR, '0123456789', 'abcdefghij') AS w FROM customer)
  SELECT page_id, 0 AS item, 'Heading Firm ' || w AS company_name, '7' || d AS phone, '' AS email FROM c
  UNION ALL SELECT page_id, 1, 'Second House ' || w, '', '' FROM c"""
ORACLES["service_cards"] = """SELECT s_suppkey AS page_id, 0 AS item, s_name AS company_name, '9' || lpad(s_suppkey::VARCHAR, 9, '0') AS phone,
    'desk' || s_suppkey || '@house.in' AS email, 'Lane ' || s_suppkey AS address FROM supplier"""
ORACLES["serp_links"] = """SELECT s_suppkey AS page_id, 0 AS item, 'Firm ' || translate(s_suppkey::VARCHAR, '0123456789', 'abcdefghij') AS company_name,
    'https://www.firm' || s_suppkey || '.in/a' AS website FROM supplier
    UNION ALL SELECT s_suppkey, 1, 'Other house', 'http://other' || s_suppkey || '.in' FROM supplier"""
ORACLES["site_search_leads"] = """SELECT 'https://www.justdial.com/one' || s_suppkey AS url, 0 AS task, s_name AS company_name,
    '9' || lpad(s_suppkey::VARCHAR, 9, '0') AS phone, 'https://www.justdial.com/one' || s_suppkey AS website, 'justdial' AS source FROM supplier"""
ORACLES["sorted_cities"] = _with(f"""SELECT city, {sql_map(fv.CITIES)}[city] AS region, n AS listings FROM
    (SELECT unnest({_CITIES}) AS city) LEFT JOIN (SELECT city, count(*) AS n FROM listings GROUP BY city) USING (city)""")
ORACLES["lead_sorted_counts"] = ORACLES["lead_counts"]


def _jobs_sql() -> str:
    """The searches of LEAD_JOBS: job, source, rank, task, category and its number, city and its number, limit."""
    cats, cities = [c[0] for c in fv.CATEGORIES], [c[0] for c in fv.CITIES]
    rows = []
    for job, wanted, places, queries, sources, most in LEAD_JOBS:
        own = [c for c in wanted if c in cats] or cats
        near = [p.strip().title() for p in places if p.strip()] or fv.DEFAULT_CITIES
        asked = [q.strip() for q in queries if q.strip()]
        for source in sources:
            rank = fv.SOURCE_PHASES.index(source)
            searches = [(c, cats.index(c), "") for c in own] + ([("Custom", -1, q) for q in asked] if source == "bing" else [])
            rows += [f"({job}, '{source}', {rank}, {i * len(near) + j}, '{c}', {n}, '{q}', '{city}', {cities.index(city)}, {most})"
                     for i, (c, n, q) in enumerate(searches) for j, city in enumerate(near)]
    return "jobs(job_id, source, rank, task, category, cat_no, query, city, city_no, most) AS (VALUES " + ", ".join(rows) + ")"


_HAS_SLUG = ", ".join(str(i) for i, c in enumerate(fv.CATEGORIES) if c[4])
ORACLES["lead_pipeline"] = f"""
WITH {_BASE}, {_jobs_sql()},
f AS (SELECT c_custkey AS k, c_custkey % 17 AS cat_no, c_nationkey % 15 AS city_no, lpad(c_custkey::VARCHAR, 9, '0') AS digits, * FROM customer),
found AS (
  SELECT j.*, k, c_name AS company_name, CASE WHEN k % 2 = 0 THEN '9' || digits ELSE '' END AS phone,
    CASE WHEN k % 3 = 1 THEN 'sales' || k || '@firm.in' ELSE '' END AS email,
    CASE WHEN k % 4 <> 3 THEN 'https://www.firm' || k || '.in/home' ELSE '' END AS website,
    CASE WHEN k % 7 = 0 THEN 'Plot ' || k ELSE '' END AS address
  FROM jobs j JOIN f USING (cat_no, city_no) WHERE source = 'indiamart'
  UNION ALL SELECT j.*, k, upper(replace(c_name, '#', ' ')), '9' || digits, '', 'https://www.firm' || k || '.in/home', ''
  FROM jobs j JOIN f ON f.city_no = j.city_no AND (f.cat_no = j.cat_no AND c_mktsegment IN ('MACHINERY', 'FURNITURE') OR c_mktsegment = query)
  WHERE source = 'bing' AND (greatest(j.cat_no, 0) + j.city_no) % 11 <> 10
  UNION ALL SELECT j.*, s_suppkey, s_name, '9' || lpad(s_suppkey::VARCHAR, 9, '0'), '', '', CASE WHEN s_suppkey % 2 = 0 THEN 'Lane ' || s_suppkey ELSE '' END
  FROM jobs j JOIN supplier ON s_suppkey % 17 = cat_no AND s_nationkey % 15 = city_no WHERE source = 'sulekha' AND cat_no IN ({_HAS_SLUG})
  UNION ALL SELECT j.*, k, c_name, '6' || digits, '', 'https://www.justdial.com/firm' || k, ''
  FROM jobs j JOIN f USING (cat_no, city_no) WHERE source = 'justdial' AND k % 10 = 0 AND k % 30 <> 0),
firsts AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY job_id,
  left(regexp_replace(lower(company_name), '[^\\pL\\pN_]+', '', 'g'), 40), city ORDER BY rank, task, k) = 1),
capped AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY rank, task, k) <= most),
filled AS (SELECT c.* EXCLUDE (phone, email, address), coalesce(nullif(phone, ''), site_phone, '') AS phone,
    coalesce(nullif(email, ''), site_email, '') AS email, coalesce(nullif(address, ''), site_address, '') AS address, site IS NOT NULL AS was_enriched
  FROM capped c LEFT JOIN sites ON website <> '' AND phone = '' AND email = '' AND site = replace(website, '/home', ''))
SELECT job_id::BIGINT AS job_id, source, company_name, category, city, phone, email, website, address, was_enriched,
  CASE WHEN phone <> '' THEN 3 ELSE 0 END + CASE WHEN email <> '' THEN 3 ELSE 0 END + CASE WHEN website <> '' THEN 1 ELSE 0 END
    + CASE WHEN address <> '' THEN 1 ELSE 0 END AS quality_score FROM filled"""
_ENCODED = "replace(url_encode({}), '%20', '+')"
ORACLES["blocked_pages"] = f"""
WITH c AS (SELECT c_custkey AS k, c_custkey % 17 AS cat_no, c_nationkey % 15 AS city_no, c_custkey // 5100 AS page_no, c_mktsegment,
    ({_CITIES})[c_nationkey % 15 + 1] AS city FROM customer),
q AS (SELECT DISTINCT page_no, ({sql_list([c[2][0] for c in fv.CATEGORIES])})[cat_no + 1] || ' ' || city || ' India contact phone' AS t
  FROM c WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE') AND (cat_no + city_no) % 11 = 10
  UNION ALL SELECT DISTINCT page_no, c_mktsegment || ' ' || city || ' India' FROM c WHERE city_no % 11 = 10)
SELECT 'https://www.bing.com/search?q=' || {_ENCODED.format('t')} || '&count=10&mkt=en-IN&setlang=en-IN&cc=IN' AS url, 'no result list' AS reason FROM q
UNION ALL SELECT s_suppkey::VARCHAR, 'short page' FROM supplier WHERE s_suppkey % 3 = 2"""
ORACLES["rejected_requests"] = """SELECT c_custkey AS request_id, CASE WHEN (c_custkey * 7) % 6000 NOT BETWEEN 1 AND 5000 THEN 'lead limit out of range'
    ELSE 'too many urls' END AS reason FROM customer
  WHERE (c_custkey * 7) % 6000 NOT BETWEEN 1 AND 5000 OR (c_custkey % 2 = 0 AND c_custkey % 60 > 50)"""
