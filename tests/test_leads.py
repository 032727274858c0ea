"""Leads on small inputs."""

from pyspark.sql import functions as F

from papertrawl.operators import lead_reports as R
from papertrawl.operators import leads as L
from papertrawl.sources import rendered, tables

SCHEMA = ("source string, source_rank int, task int, item bigint, company_name string, category string, city string, "
          "phone string, mobile string, email string, website string, address string, description string")


def lead(rank, task, item, name, city="Delhi", phone="", email="", website="", address="", mobile=""):
    return ("s", rank, task, item, name, "trader", city, phone, mobile, email, website, address, "")


def test_first_arrival_wins_and_dedup_is_idempotent(spark):
    df = spark.createDataFrame([
        lead(1, 0, 0, "Acme & Co", phone="2"), lead(0, 5, 1, "ACME CO"), lead(0, 5, 0, "acme, co.", phone="1"),
        lead(0, 0, 0, "Acme Co", city="Pune"), lead(0, 0, 1, "ab"),
    ], SCHEMA)
    once = L.dedup_leads(df)
    assert sorted((r["company_name"], r["city"], r["phone"]) for r in once.collect()) == [
        ("Acme Co", "Pune", ""), ("acme, co.", "Delhi", "1")]
    assert L.dedup_leads(once.drop("dedup_key")).count() == once.count()
    assert L.cap_leads(once, 1).first()["city"] == "Pune"


def test_one_lead_holding_a_third_of_all_rows(spark):
    df = spark.range(3000).select(
        F.lit("s").alias("source"), F.lit(0).alias("source_rank"), F.lit(0).alias("task"), F.col("id").alias("item"),
        F.when(F.col("id") % 3 == 0, "Hot Firm").otherwise(F.concat(F.lit("Firm "), "id")).alias("company_name"),
        F.lit("Delhi").alias("city"),
    )
    got = L.dedup_leads(df)
    assert got.count() == 2001
    assert got.filter("company_name = 'Hot Firm'").first()["item"] == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # cut before and after the shuffle


def _page(site, path, html):
    return (site, path, html)


def test_enrichment_stops_once_complete(spark):
    pages = spark.createDataFrame([
        _page("http://a.in", "/contact", "<p>9876543210</p>"),
        _page("http://a.in", "/about", "<p>me@a.co.in 9876543211</p><address>Street 1</address>"),
        _page("http://a.in", "/", "<address>Street 2</address>"),
        _page("http://b.in", "/contact", "<p>9876543212 x.y@b.co.in</p>"),
        _page("http://b.in", "/", "<address>Late</address>"),
        _page("http://c.in", "/elsewhere", "<p>9876543213</p>"),
    ], "site string, path string, html string")
    leads = spark.createDataFrame([
        lead(0, 0, 0, "Aaa", website="http://a.in/x"), lead(0, 0, 1, "Bbb", website="http://b.in"),
        lead(0, 0, 2, "Ccc", website="http://c.in"), lead(0, 0, 3, "Ddd", website="http://a.in", phone="1"),
        lead(0, 0, 4, "Eee"),
    ], SCHEMA)
    contacts = L.site_contacts(pages, tables.contact_paths(spark))
    got = {r["company_name"]: (r["phone"], r["email"], r["address"]) for r in L.enrich_leads(leads, contacts).collect()}
    assert got == {
        "Aaa": ("9876543210", "me@a.co.in", "Street 1"), "Bbb": ("9876543212", "x.y@b.co.in", ""),
        "Ccc": ("", "", ""), "Ddd": ("1", "", ""), "Eee": ("", "", ""),
    }
    capped = {r["company_name"]: r["phone"] for r in L.enrich_leads(leads, contacts, most=1).collect()}
    assert capped["Aaa"] and not capped["Bbb"]


def test_each_phone_once_per_page(spark):
    html = ("<div><h2>First House</h2> 9876543215</div><div><h3>Second House</h3> 9876543215 9876543216</div>"
            "<div><h2>first house</h2></div>")
    pages = spark.createDataFrame([(1, html, "c", "d")], "page_id int, html string, category string, city string")
    got = [(r["company_name"], r["phone"]) for r in L.leads_from_headings(pages).orderBy("item").collect()]
    # the second heading finds its first phone taken; the third one takes none that is left to keep
    assert got == [("First House", "9876543215"), ("Second House", "9876543216")]


def test_links_when_a_result_page_has_no_items(spark):
    html = "".join(f'<a href="https://www.host{i % 10}.in/p{i}">Label {i}</a>' for i in range(30))
    html += '<a href="https://www.facebook.com/x">Social</a><a href="/local">Local</a>'
    pages = spark.createDataFrame([(1, html, "c", "d")], "page_id int, html string, category string, city string")
    # every outside host once, or as many as asked for
    for most, hosts in ((None, 10), (8, 8)):
        got = [r["website"] for r in L.leads_from_serp(pages, most).orderBy("item").collect()]
        assert got == [f"https://www.host{i}.in/p{i}" for i in range(hosts)]


def test_unknown_categories_mean_all(spark):
    wanted = spark.createDataFrame([("nonsense",)], "category string")
    assert L.restrict_categories(tables.categories(spark), wanted).count() == 17
    wanted = spark.createDataFrame([("nonsense",), ("fintech",)], "category string")
    assert [r["category"] for r in L.restrict_categories(tables.categories(spark), wanted).collect()] == ["fintech"]


def test_segments_add_up(spark, sf):
    leads = L.score_leads(L.dedup_leads(rendered.lead_listings(spark, sf)))
    rows = {r["segment"]: r["leads"] for r in R.segment_summary(leads).collect()}
    total = rows.pop("TOTAL")
    assert total == sum(rows.values()) == leads.count()


def _fetched(source, url, html, page_no=0):
    return (source, url, page_no, html)


def test_two_jobs_that_ask_for_one_page_read_it_once_and_each_keep_its_leads(spark):
    from papertrawl import fixed_values as fv
    from papertrawl.operators import leads as L

    requests = spark.createDataFrame(
        [(1, ["trader"], ["Pune"], [], ["indiamart"], 1), (2, ["trader"], ["Pune"], [], ["indiamart", "justdial"], 10)],
        "request_id bigint, categories array<string>, locations array<string>, search_queries array<string>, sources array<string>, max_leads int")
    urls = {r["source"]: r["url"] for r in L.request_grid(requests).collect()}
    cards = "".join(f'<div class="bx"><h3><a>{n}</a></h3><span class="phn">98765432{i:02d}</span></div>' for i, n in enumerate(
        ["Acme Works", "ACME works", "Bolt Ltd"]))
    pages = spark.createDataFrame(
        [_fetched("indiamart", urls["indiamart"], cards), _fetched("indiamart", urls["indiamart"], '<div class="bx"><h3><a>Late Firm</a></h3></div>', 1),
         _fetched("justdial", urls["justdial"], f'<a href="https://www.{fv.SITE_SEARCH_HOST}/a">x</a><a href="https://www.{fv.SITE_SEARCH_HOST}/gone">y</a>'),
         _fetched("indiamart", "https://nobody.asked", cards), _fetched("other", "https://x", cards)],
        "source string, url string, page_no int, html string")
    linked = spark.createDataFrame([(f"https://www.{fv.SITE_SEARCH_HOST}/a", "<h1>Dial Shop</h1>")], "url string, html string")
    contacts = spark.createDataFrame([], "site string, site_phone string, site_email string, site_address string")
    found = L.lead_pipeline(requests, pages, linked, contacts).collect()
    assert sorted((r.job_id, r.company_name, r.category, r.city) for r in found) == [
        (1, "Acme Works", "trader", "Pune"), (2, "Acme Works", "trader", "Pune"), (2, "Bolt Ltd", "trader", "Pune"),
        (2, "Dial Shop", "trader", "Pune"), (2, "Late Firm", "trader", "Pune")]
    assert "max_leads" not in found[0].asDict()


def test_a_job_run_again_replaces_its_own_leads_only(spark, tmp_path):
    from papertrawl.sources import sinks

    path, kind = str(tmp_path / "leads"), "job_id long, company_name string"

    def stored():
        return sorted((r.job_id, r.company_name) for r in spark.read.schema(kind).parquet(path).collect())

    sinks.write_leads(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], kind), path)
    for _ in range(2):
        sinks.write_leads(spark.createDataFrame([(1, "b2")], kind), path, spark.createDataFrame([(1,), (3,)], "job_id long"))
        assert stored() == [(1, "b2"), (2, "c")]
    other = str(tmp_path / "batches")
    for batch in (0, 1, 1):
        sinks.write_lead_batch(spark.createDataFrame([(1, f"x{batch}")], kind), batch, other)
    assert sorted(r.company_name for r in spark.read.parquet(other).collect()) == ["x0", "x1"]


def test_refused_requests_and_blocked_pages_come_with_a_reason(spark):
    from papertrawl.operators import leads as L

    requests = spark.createDataFrame([(1, [], [], 0, ["u"]), (2, [], [], None, None), (3, [], [], 5, []), (4, [], [], 5, ["u"] * 51), (5, [], [], 5, ["u"])],
                                     "request_id long, search_queries array<string>, locations array<string>, max_leads int, urls array<string>")
    assert {(r.request_id, r.reason) for r in L.rejected_requests(requests).collect()} == {
        (1, "lead limit out of range"), (2, "lead limit out of range"), (3, "no urls"), (4, "too many urls")}
    assert [r.request_id for r in L.clean_requests(requests).collect()] == [5]
    pages = spark.createDataFrame([(1, None), (2, "x" * 5000), (3, "b_results" * 600), (4, "b_results")], "page_id long, html string")
    assert {(r.page_id, r.reason) for r in L.blocked_pages(pages).collect()} == {(1, "short page"), (2, "no result list"), (4, "short page")}
    assert [r.page_id for r in L.reject_bot_pages(pages).collect()] == [3]


def test_trees_are_made_a_slice_of_pages_at_a_time():
    """A batch of rows may hold any number of long pages; their trees are not all held at once."""
    import pyarrow as pa

    from papertrawl.functions import dom as D

    pages = [f"<p>{'x' * 3000} {i}</p>" for i in range(1000)] + [None, "", "<b>last</b>"]
    parts = list(D.parse_dom.func(iter([pa.array(pages, pa.string()), pa.array([], pa.string())])))
    trees = pa.concat_arrays(parts).to_pylist()
    assert len(parts) > 5 and len(trees) == len(pages)
    assert [t["strings"][0]["text"].split()[-1] for t in trees[:1000]] == [str(i) for i in range(1000)]
    assert [t["strings"] for t in trees[1000:1002]] == [[], []] and trees[-1]["strings"][0]["text"] == "last"
