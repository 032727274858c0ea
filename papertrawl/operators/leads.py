"""Lead directory: listing pages to leads, request grid, dedup, cap, enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrawl import fixed_values as fv
from papertrawl.functions import contacts as C
from papertrawl.functions import dom as D
from papertrawl.functions import text as T
from papertrawl.operators.ranking import first_per_key, number_rows
from papertrawl.sources import tables

LEAD_FIELDS = ["company_name", "category", "city", "phone", "mobile", "email", "website", "address",
               "source", "description"]
ARRIVAL = ["source_rank", "task", "item"]


def _lead(**values: Column) -> Column:
    return F.struct(*[T.or_blank(values.get(f, F.lit(""))).cast("string").alias(f) for f in LEAD_FIELDS])


def _first(values: Column) -> Column:
    return T.or_blank(F.get(values, 0))


# ---- search requests ------------------------------------------------------------------------------


def request_rejection(requests: DataFrame) -> Column:
    """Why a request is refused; null when it is accepted. A request may name 1 to 50 urls, if it names any."""
    reason = F.when(~F.coalesce(F.col("max_leads").between(1, 5000), F.lit(False)), "lead limit out of range")
    if "urls" in requests.columns:
        return reason.when(F.size("urls") == 0, "no urls").when(F.size("urls") > 50, "too many urls")
    return reason


def rejected_requests(requests: DataFrame) -> DataFrame:
    """The requests that clean_requests leaves out, with the reason."""
    return requests.withColumn("reason", request_rejection(requests)).filter("reason is not null")


def clean_requests(requests: DataFrame) -> DataFrame:
    """Accepted requests: queries and places trimmed, blank ones dropped, places in title case.

    Columns: request_id, search_queries array, locations array, max_leads int, urls array (optional).
    """
    def tidy(c: str) -> Column:
        return F.filter(F.transform(F.col(c), T.strip), lambda x: x != "")

    return requests.filter(request_rejection(requests).isNull()).withColumns({
        "search_queries": tidy("search_queries"),
        "locations": F.transform(tidy("locations"), T.title_case),
    })


def restrict_categories(dim: DataFrame, wanted: DataFrame) -> DataFrame:
    """Known categories among the wanted ones; all of them when none is known."""
    known = dim.join(wanted.select("category"), "category", "left_semi")
    return known.unionByName(dim.filter(~known.exists()))


def gate_sources(df: DataFrame, requested: list[str]) -> DataFrame:
    return df.filter(F.col("source").isin(requested))


def request_grid(requests: DataFrame) -> DataFrame:
    """Every search to run for a table of requests: category by city for each source, custom query by city.

    Columns: request_id, categories, locations, search_queries, sources (arrays). Requests without known
    categories use all of them; requests without locations use the default cities. Expansion is row-local.
    task numbers the searches of a request and source in the order in which they run.
    """
    known_ids = [c[0] for c in fv.CATEGORIES]
    known = F.filter("categories", lambda c: c.isin(known_ids))
    places = C.prefer(F.col("locations"), F.lit(fv.DEFAULT_CITIES))
    base = requests.select(
        "request_id", "sources", "search_queries",
        C.prefer(known, F.lit(known_ids)).alias("categories"),
        F.size(places).alias("cities"), F.posexplode(places).alias("city_at", "city"),
    )
    dim = F.broadcast(tables.categories(requests.sparkSession))
    # searches of a source run category by category, custom queries last, each city by city
    grid = base.select(
        "request_id", "sources", "city", "city_at", "cities", F.posexplode("categories").alias("at", "category")
    ).withColumn("task", F.col("at") * F.col("cities") + F.col("city_at")).join(dim, "category")
    slug = F.create_map(*[F.lit(x) for kv in fv.SERVICES_CITY_SLUGS.items() for x in kv])

    def search(source: str, text: Column, url: Column) -> Column:
        return F.struct(F.lit(source).alias("source"), text.alias("search_text"), url.alias("url"))

    def encoded(template: str, *parts: Column) -> Column:
        return F.format_string(template, *[F.url_encode(p) for p in parts])

    phrase = F.concat_ws(" ", F.get("keywords", 0), F.col("city"), F.lit("India contact phone"))
    three_words = F.array_join(F.slice(F.split(F.get("keywords", 0), " "), 1, 3), " ")
    site_text = F.concat_ws(" ", F.lit("site:" + fv.SITE_SEARCH_HOST), three_words, F.col("city"))
    services_url = F.format_string(
        fv.SERVICES_URL, F.col("services_slug"), F.coalesce(slug[F.col("city")], F.lower("city"))
    )
    searches = F.array(
        search("indiamart", F.col("listing_term"), encoded(fv.LISTING_URL, F.col("listing_term"), F.col("city"))),
        search("bing", phrase, encoded(fv.SERP_URL, phrase)),
        F.when(F.col("services_slug").isNotNull(), search("sulekha", F.col("services_slug"), services_url)),
        search("justdial", site_text, encoded(fv.SITE_SEARCH_URL, site_text)),
    )
    by_category = grid.select("request_id", "sources", "category", "city", "task", F.inline(searches))
    query = F.concat_ws(" ", F.col("query"), F.col("city"), F.lit("India"))
    custom = base.select(
        "request_id", "sources", "city", "city_at", "cities", "categories", F.posexplode("search_queries").alias("at", "query")
    ).select(
        "request_id", "sources", F.lit("Custom").alias("category"), "city",
        ((F.size("categories") + F.col("at")) * F.col("cities") + F.col("city_at")).alias("task"),
        F.inline(F.array(search("bing", query, encoded(fv.SERP_URL, query)))),
    )
    return (
        by_category.unionByName(custom)
        .filter(F.array_contains("sources", F.col("source")))
        .drop("sources")
    )


# ---- pages to leads -------------------------------------------------------------------------------


def blocked_reason(least: int = 5000, marker: str = "b_results") -> Column:
    """Why a search result page is none: bots get short pages, or pages without a result list."""
    html = T.or_blank("html")
    return F.when(F.length(html) < least, "short page").when(~F.contains(html, F.lit(marker)), "no result list")


def reject_bot_pages(pages: DataFrame, least: int = 5000, marker: str = "b_results") -> DataFrame:
    return pages.filter(blocked_reason(least, marker).isNull())


def blocked_pages(pages: DataFrame, least: int = 5000, marker: str = "b_results") -> DataFrame:
    """The pages that reject_bot_pages leaves out, with the reason: what has to be fetched again."""
    return pages.withColumn("reason", blocked_reason(least, marker)).filter("reason is not null")


def _explode_leads(df: DataFrame, leads: Column) -> DataFrame:
    """One row per lead; item is the position on the page."""
    keep = [c for c in df.columns if c not in ("html", "dom", "category", "city")]
    return (
        df.select(*keep, F.posexplode(leads).alias("item", "lead")).select(*keep, "item", "lead.*")
    )


def _listing_lead(tree: Column) -> Column:
    """A listing card; an address in a data attribute goes before the ones found in the text."""
    def own_phone(el: Column) -> Column:
        href = D.attr(el, "href")
        return F.when(href.startswith("tel:"), F.regexp_replace(F.substr(href, F.lit(5)), r"\D", "")).otherwise(
            _first(C.phones(D.text_of(tree, el)))
        )

    def read(text: Column) -> Column:
        phone_el = D.first_element(tree, fv.LISTING_PHONE)
        marked = F.transform(D.select(tree, "[data-email*='']"), lambda e: D.attr(e, "data-email"))
        links = F.filter(
            F.transform(D.select(tree, "a[href^='http']"), lambda a: D.attr(a, "href")),
            lambda h: ~F.contains(h, F.lit("indiamart")) & ~h.rlike(fv.ASSET_SUFFIX),
        )
        return _lead(
            company_name=C.clean_name(D.first_filled_text(tree, fv.LISTING_NAME)),
            phone=F.left(
                F.coalesce(T.blank_to_null(D.bind(phone_el, own_phone)), _first(C.phones(text))), F.lit(15)
            ),
            email=F.coalesce(
                T.blank_to_null(T.or_blank(T.last(F.filter(marked, lambda m: m != "")))),
                F.get(C.jsonld_emails(D.jsonld_scripts(tree)), 0), F.get(C.emails(text), 0),
            ),
            website=_first(links),
            address=F.left(D.first_filled_text(tree, fv.LISTING_ADDRESS), F.lit(200)),
            source=F.lit("indiamart"), category=F.col("category"), city=F.col("city"),
        )

    return D.bind(D.page_text(tree), read)


def _heading_leads(dom: Column) -> Column:
    """Leads from headings: contacts come from the surrounding two levels, each phone is used once.

    The fold walks the headings of one page in order, carrying the phones already taken.
    """
    wanted = D.select(dom, ", ".join(fv.HEADINGS))

    def parent(el: Column) -> Column:
        return F.get(dom["elements"], el["parent"].cast("int"))

    def read(h: Column) -> Column:
        name = C.clean_name(D.text_of(dom, h, ""))
        levels = D.bind(parent(h), lambda up: F.concat_ws(
            " ", D.text_of(dom, up), T.blank_to_null(D.text_of(dom, parent(up)))
        ))
        return D.bind(F.struct(name.alias("name"), levels.alias("levels")), lambda x: D.bind(
            F.concat_ws(" ", x["name"], x["levels"]),
            lambda around: F.struct(
                x["name"].alias("name"), C.phones(around).alias("phones"), C.emails(around).alias("emails")
            ),
        ))

    headings = F.filter(F.transform(wanted, read), lambda h: F.length(h["name"]).between(4, 120))
    start = F.struct(
        F.array().cast("array<string>").alias("used"),
        F.array().cast("array<struct<name:string,phone:string,email:string>>").alias("leads"),
    )

    def take(acc: Column, h: Column) -> Column:
        phone = _first(F.array_except(h["phones"], acc["used"]))
        lead = F.struct(h["name"].alias("name"), phone.alias("phone"), _first(h["emails"]).alias("email"))
        return F.struct(
            F.when(phone != "", F.array_append(acc["used"], phone)).otherwise(acc["used"]).alias("used"),
            F.array_append(acc["leads"], lead).alias("leads"),
        )

    def first_by_name(folded: Column) -> Column:
        keys = F.transform(folded, lambda x: C.name_key(x["name"]))
        return D.bind(keys, lambda ks: F.filter(
            folded, lambda x, i: F.array_position(ks, C.name_key(x["name"])) == i + 1
        ))

    return F.transform(
        D.bind(F.aggregate(headings, start, take)["leads"], first_by_name),
        lambda x: _lead(company_name=x["name"], phone=x["phone"], email=x["email"],
                        source=F.lit("indiamart_regex"), category=F.col("category"), city=F.col("city")),
    )


def leads_from_headings(pages: DataFrame) -> DataFrame:
    parsed = pages.withColumn("dom", D.parse_dom("html"))
    return _explode_leads(parsed, _heading_leads(F.col("dom")))


def _card_leads(dom: Column) -> Column:
    cards = D.select_cascade(dom, fv.LISTING_CARDS)
    from_cards = F.filter(
        F.transform(cards, lambda c: D.bind(D.subtree(dom, c), _listing_lead)),
        lambda x: F.length(x["company_name"]) >= 3,
    )
    return D.bind(from_cards, lambda found: F.when(F.size(found) > 0, found).otherwise(_heading_leads(dom)))


def leads_from_cards(pages: DataFrame) -> DataFrame:
    """Listing pages (html, category, city, …) to leads; pages without any card lead use their headings."""
    return _explode_leads(pages.withColumn("dom", D.parse_dom("html")), _card_leads(F.col("dom")))


def _service_leads(dom: Column) -> Column:
    def read(tree: Column) -> Column:
        return D.bind(D.page_text(tree), lambda text: _lead(
            company_name=C.clean_name(D.first_filled_text(tree, fv.SERVICE_NAME)),
            phone=_first(C.phones(text)), email=_first(C.emails(text)),
            address=F.left(D.first_filled_text(tree, fv.SERVICE_ADDRESS), F.lit(200)),
            source=F.lit("sulekha"), category=F.col("category"), city=F.col("city"),
        ))

    found = F.transform(
        D.select_cascade(dom, fv.SERVICE_CARDS), lambda card: D.bind(D.subtree(dom, card), read)
    )
    return F.filter(found, lambda x: F.length(x["company_name"]) >= 3)


def leads_from_services(pages: DataFrame) -> DataFrame:
    return _explode_leads(pages.withColumn("dom", D.parse_dom("html")), _service_leads(F.col("dom")))


def _raw_link_leads(dom: Column, n: int | None = None) -> Column:
    """Links to distinct outside hosts; the first n of a page where n is given (8 for parity)."""
    links = F.transform(
        D.select(dom, "a[href^='http']"),
        lambda a: F.struct(D.attr(a, "href").alias("href"), D.text_of(dom, a, "").alias("label"),
                           T.bare_host(D.attr(a, "href")).alias("host")),
    )
    outside = F.filter(links, lambda x: ~C.excluded_host(x["host"]))

    def first_by_host(found: Column) -> Column:
        return D.bind(F.transform(found, lambda x: x["host"]), lambda hosts: F.filter(
            found, lambda x, i: F.array_position(hosts, x["host"]) == i + 1
        ))

    firsts = D.bind(outside, first_by_host)
    named = F.filter(firsts, lambda x: F.length(x["label"]) >= 4)
    named = named if n is None else F.slice(named, 1, n)
    return F.transform(
        named,
        lambda x: _lead(company_name=C.clean_name(x["label"]), website=x["href"], source=F.lit("bing"),
                        category=F.col("category"), city=F.col("city")),
    )


def _serp_leads(dom: Column, most_links: int | None = None) -> Column:
    def read(tree: Column) -> Column:
        # the link goes before the heading around it, which carries no address
        title_el = F.coalesce(*[D.select_one(tree, s) for s in fv.SERP_TITLE])
        seen = F.struct(
            D.text_of(tree, title_el, "").alias("title"), D.attr(title_el, "href").alias("url"),
            D.text_of(tree, D.select_one(tree, fv.SERP_SNIPPET)).alias("snippet"),
        )

        def lead(x: Column) -> Column:
            text = F.concat_ws(" ", x["title"], x["snippet"])
            usable = (x["url"] != "") & ~C.excluded_host(T.url_host(x["url"]))
            return _lead(
                company_name=F.when(usable, C.clean_name(x["title"])), phone=_first(C.phones(text)),
                email=_first(C.emails(text)), website=x["url"], source=F.lit("bing"),
                category=F.col("category"), city=F.col("city"),
            )

        return D.bind(seen, lead)

    def of_items(items: Column) -> Column:
        found = F.filter(
            F.transform(items, lambda item: D.bind(D.subtree(dom, item), read)), lambda x: x["company_name"] != ""
        )
        return F.when(F.size(items) > 0, found).otherwise(_raw_link_leads(dom, most_links))

    return D.bind(D.select_cascade(dom, fv.SERP_ITEMS), of_items)


def leads_from_serp(pages: DataFrame, most_links: int | None = None) -> DataFrame:
    """Search result pages to leads; pages without result items fall back to their outside links, all or the first few."""
    return _explode_leads(pages.withColumn("dom", D.parse_dom("html")), _serp_leads(F.col("dom"), most_links))


def _site_links(dom: Column, site: str = fv.SITE_SEARCH_HOST) -> Column:
    links = F.transform(D.select(dom, "a[href^='http']"), lambda a: D.attr(a, "href"))
    return F.array_distinct(F.filter(links, lambda h: F.contains(h, F.lit(site))))


def search_result_urls(pages: DataFrame, site: str = fv.SITE_SEARCH_HOST, n: int | None = None) -> DataFrame:
    """Distinct links of a site on each search page, in order; the first n where n is given (6 for parity)."""
    urls = _site_links(F.col("dom"), site)
    urls = urls if n is None else F.slice(urls, 1, n)
    keep = [c for c in pages.columns if c not in ("html", "url")]
    return (
        pages.withColumn("dom", D.parse_dom("html"))
        .select(*keep, F.posexplode(urls).alias("item", "url"))
    )


def lead_from_page(pages: DataFrame, source: str) -> DataFrame:
    """A business page (url, html, category, city, …) to one lead; contacts from ld+json first, then text."""
    dom = F.col("dom")
    blocks, text = C.jsonld_blocks("html"), F.col("_text")
    name = C.clean_name(D.first_filled_text(dom, fv.BUSINESS_NAME))
    lead = _lead(
        company_name=name,
        phone=F.coalesce(F.get(C.jsonld_phones(blocks), 0), F.get(C.phones(text), 0)),
        email=F.coalesce(F.get(C.jsonld_emails(blocks), 0), F.get(C.emails(text), 0)),
        website=F.col("url"), source=F.lit(source), category=F.col("category"), city=F.col("city"),
    )
    return _explode_leads(
        pages.withColumn("dom", D.parse_dom("html")).withColumn("_text", D.page_text(dom)),
        F.filter(F.array(lead), lambda x: F.length(x["company_name"]) >= 3),
    ).drop("_text")


def leads_from_site_search(searches: DataFrame, pages: DataFrame, source: str = "justdial") -> DataFrame:
    """Search pages (with category and city) to the linked pages (url, html) to leads; html is joined once."""
    urls = search_result_urls(searches).withColumnRenamed("item", "task")
    return lead_from_page(urls.join(pages.select("url", "html"), "url"), source)


# ---- collecting -----------------------------------------------------------------------------------


def union_sources(*parts: DataFrame) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def leads_on_pages(pages: DataFrame, most_links: int | None = None) -> DataFrame:
    """Fetched pages (source, url, page_no, html) of the three sources whose pages hold leads, read in one pass.

    A page is parsed once, whatever the number of jobs that asked for it, and read by its source's reader. item is
    the place among all leads of the url's pages, as far as their order goes.
    """
    dom, source = F.col("dom"), F.col("source")
    read = (F.when(source == "indiamart", _card_leads(dom)).when(source == "sulekha", _service_leads(dom))
            .when(blocked_reason().isNull(), _serp_leads(dom, most_links)))
    known = pages.filter(source.isin("indiamart", "bing", "sulekha")).withColumns(
        {"category": F.lit(""), "city": F.lit("")})
    found = known.withColumn("dom", D.parse_dom("html")).select(
        F.col("source").alias("_source"), "url", "page_no", F.posexplode(read).alias("_at", "_lead"))
    return found.select("url", "_source", _place("page_no", "_at"), "_lead.*").drop("category", "city")


def _place(page_no: str, at: str) -> Column:
    return (F.col(page_no).cast("bigint") * (1 << 20) + F.col(at)).alias("item")


def leads_behind_searches(pages: DataFrame, linked: DataFrame, source: str = "justdial") -> DataFrame:
    """Leads of the pages that a site search links to: url (of the search), item, lead fields.

    linked: url, html. Links and leads are short rows; no page travels to another.
    """
    searches = pages.filter(F.col("source") == source).select("url", "page_no", "html")
    links = searches.withColumn("dom", D.parse_dom("html")).select(
        "url", "page_no", F.posexplode(_site_links(F.col("dom"))).alias("_at", "link")
    ).select("url", "link", _place("page_no", "_at"))
    read = lead_from_page(linked.select("url", "html", F.lit("").alias("category"), F.lit("").alias("city")), source)
    return links.join(read.withColumnRenamed("url", "link").drop("item", "category", "city"), "link").drop("link").withColumn(
        "_source", F.lit(source))


def collect_leads(requests: DataFrame, pages: DataFrame, linked: DataFrame) -> DataFrame:
    """Leads of every request from fetched pages: the searches of its grid, each with what its pages say.

    requests: see request_grid, with max_leads. Columns added to a lead: job_id, max_leads and its place in the order
    of arrival (phase, search, position).
    """
    phase = F.create_map(*[F.lit(x) for i, s in enumerate(fv.SOURCE_PHASES) for x in (s, i)])
    grid = request_grid(requests).select(
        F.col("request_id").alias("job_id"), F.col("source").alias("_source"), "category", "city", "task", "url")
    found = union_sources(leads_on_pages(pages), leads_behind_searches(pages, linked))
    leads = grid.join(found, ["_source", "url"]).withColumn("source_rank", phase[F.col("_source")])
    return leads.drop("_source", "url").join(
        requests.select(F.col("request_id").alias("job_id"), "max_leads"), "job_id")


def lead_pipeline(requests: DataFrame, pages: DataFrame, linked: DataFrame, contacts: DataFrame) -> DataFrame:
    """Requests and fetched pages to the scored leads of every job, each within its own limit."""
    leads = collect_leads(clean_requests(requests), pages, linked)
    return lead_directory(leads, contacts, "max_leads", ["job_id"]).drop("max_leads")


def dedup_leads(leads: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """First lead per normalised name and city, in order of phase, task and position. per: columns of the job."""
    keyed = leads.filter(F.length("company_name") >= 3).withColumn(
        "dedup_key", C.dedup_key("company_name", "city")
    )
    return first_per_key(keyed, [*per, "dedup_key"], [F.col(c) for c in ARRIVAL])


def cap_leads(leads: DataFrame, most: int | str = 500, per: Sequence[str] = ()) -> DataFrame:
    """The first leads to arrive (a top-n plan), or the first of every job.

    most: a number, or with `per` also the name of a column with the request's own limit. Jobs are numbered by
    ranges of the arrival order, so a job of any size is many tasks; job ids are not null.
    """
    if not per:
        return leads.orderBy(*ARRIVAL).limit(most)
    limit = F.col(most) if isinstance(most, str) else F.lit(most)
    return number_rows(leads, list(per), ARRIVAL, "_arrived").filter(F.col("_arrived") <= limit).drop("_arrived")


def site_contacts(pages: DataFrame, known_paths: DataFrame) -> DataFrame:
    """What a site's contact pages say: first phone and e-mail in path order, and the address of the first
    page that has one, unless phone and e-mail were both complete before that page.

    pages: site, path, html. The HTML is read where it lies; only short rows are shuffled by site.
    """
    dom = F.col("dom")
    blocks = C.jsonld_blocks("html")
    read = (
        pages.join(F.broadcast(known_paths), "path")
        .withColumn("dom", D.parse_dom("html"))
        .select(
            "site", "path_rank",
            F.coalesce(F.get(C.jsonld_phones(blocks), 0), F.get(C.phones("html"), 0)).alias("phone"),
            F.coalesce(F.get(C.jsonld_emails(blocks), 0), F.get(C.emails("html"), 0)).alias("email"),
            T.blank_to_null(
                F.left(D.first_filled_text(dom, fv.SITE_ADDRESS), F.lit(200))
            ).alias("address"),
        )
    )

    def first(c: str, what: str) -> Column:
        return F.min(F.when(F.col(c).isNotNull(), F.struct("path_rank", c))).alias(what)

    per_site = read.groupBy("site").agg(first("phone", "p"), first("email", "e"), first("address", "a"))
    complete = F.greatest("p.path_rank", "e.path_rank")
    stop = F.when(F.col("p").isNotNull() & F.col("e").isNotNull(), complete)
    return per_site.select(
        "site", F.col("p.phone").alias("site_phone"), F.col("e.email").alias("site_email"),
        F.when(stop.isNull() | (F.col("a.path_rank") <= stop), F.col("a.address")).alias("site_address"),
    )


def enrich_leads(leads: DataFrame, contacts: DataFrame, most: int | None = None, per: Sequence[str] = ()) -> DataFrame:
    """Fill phone, e-mail and address of leads that have a web site and no contact.

    Contacts hold one row per site, so a site shared by many leads only skews the lead side, which the
    adaptive skew join splits; leads that need nothing are dealt by a hash, not all to one task.
    `most` limits how many leads are looked up, in order of arrival, for every job if `per` names its columns.
    """
    needy = T.is_filled("website") & ~C.has_contact()
    leads = leads.withColumn("_site", F.when(needy, T.site_base("website")))
    if most is not None:
        keys = [*per, *ARRIVAL]
        chosen = cap_leads(leads.filter(needy), most, per).select(*keys, F.lit(True).alias("_chosen"))
        leads = leads.join(chosen, keys, "left").withColumn(
            "_site", F.when(F.col("_chosen"), F.col("_site"))
        ).drop("_chosen")
    # no address of a site starts like this
    nowhere = F.concat(F.lit("none:"), F.xxhash64(*ARRIVAL).cast("string"))
    leads = leads.withColumn("_site", F.coalesce("_site", nowhere))

    def fill(c: str) -> Column:
        return T.or_blank(F.coalesce(T.blank_to_null(c), F.col(f"site_{c}"))).alias(c)

    joined = leads.join(contacts, F.col("_site") == F.col("site"), "left")
    filled = {"phone", "email", "address"}
    return joined.select(
        *[fill(c) if c in filled else F.col(c) for c in leads.columns if c != "_site"],
        F.col("site").isNotNull().alias("was_enriched"),
    )


def enrichment_stats(leads: DataFrame) -> DataFrame:
    """Leads per source, and how many looked-up ones have a phone or e-mail afterwards."""
    return leads.groupBy("source").agg(
        F.count(F.lit(1)).alias("leads"),
        F.count_if(F.col("was_enriched") & T.is_filled("phone")).alias("enriched_phone"),
        F.count_if(F.col("was_enriched") & T.is_filled("email")).alias("enriched_email"),
    )


def score_leads(leads: DataFrame) -> DataFrame:
    return leads.withColumn("quality_score", C.quality_score()).withColumn(
        "confidence_score", C.confidence_score("quality_score")
    )


def lead_directory(listings: DataFrame, contacts: DataFrame, most: int | str | None = None,
                   per: Sequence[str] = ()) -> DataFrame:
    """Deduplicated, optionally capped, enriched and scored leads; of every job on its own if `per` names its columns."""
    leads = dedup_leads(listings, per)
    if most is not None:
        leads = cap_leads(leads, most, per)
    return score_leads(enrich_leads(leads, contacts, per=per))


def lookup_dims(leads: DataFrame) -> DataFrame:
    """Region of the city and labels of the category, with defaults for unknown values."""
    spark = leads.sparkSession
    regions = F.broadcast(tables.cities(spark).select("city", "region"))
    return leads.join(regions, "city", "left").select(
        *leads.columns,
        F.coalesce("region", F.lit("other")).alias("region"),
        tables.label_of(F.col("category"), [(c[0], c[1]) for c in fv.CATEGORIES]).alias("category_label"),
        tables.label_of(F.col("category"), fv.SEGMENT_LABELS).alias("segment_label"),
    )
