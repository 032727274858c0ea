"""Reports and views over leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrawl import fixed_values as fv
from papertrawl.functions import contacts as C
from papertrawl.functions import text as T
from papertrawl.sources import tables

ONE = F.lit


def coverage(leads: DataFrame) -> DataFrame:
    return leads.agg(
        F.count(F.lit(1)).alias("total_leads"),
        F.count_if(C.has_phone()).alias("with_phone"),
        F.count_if(T.is_filled("email")).alias("with_email"),
        F.count_if(T.is_filled("website")).alias("with_website"),
        F.count_if(C.has_phone() & T.is_filled("email")).alias("phone_and_email"),
    )


def counts_by_dim(leads: DataFrame) -> DataFrame:
    """Leads per city, per category and per source in one pass."""
    sets = leads.groupingSets(
        [[F.col("city")], [F.col("category")], [F.col("source")]], "city", "category", "source"
    ).agg(F.count(F.lit(1)).alias("leads"), F.grouping_id().alias("gid"))
    dim = F.when(F.col("gid") == 3, "city").when(F.col("gid") == 5, "category").otherwise("source")
    key = F.when(F.col("gid") == 3, F.col("city")).when(F.col("gid") == 5, F.col("category")).otherwise(
        F.col("source")
    )
    return sets.select(dim.alias("dim"), key.alias("key"), "leads")


def sort_counts(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.desc("leads"), "dim", "key")


def _segment() -> Column:
    return F.lower(F.coalesce(T.blank_to_null("category"), F.lit("other")))


def segment_summary(leads: DataFrame) -> DataFrame:
    """One row per segment and a TOTAL row."""
    rows = (
        leads.withColumn("segment", _segment())
        .rollup("segment")
        .agg(
            F.count(F.lit(1)).alias("leads"),
            F.count_if(T.is_filled("phone")).alias("with_phone"),
            F.count_if(T.is_filled("email")).alias("with_email"),
            F.count_if(T.is_filled("website")).alias("with_website"),
            F.count_distinct(T.blank_to_null("city")).alias("cities"),
            F.avg(F.col("confidence_score").cast("decimal(10,3)")).alias("avg_confidence"),
            F.grouping("segment").alias("is_total"),
        )
    )
    total = F.col("is_total") == 1
    return rows.select(
        F.when(total, "TOTAL").otherwise(tables.label_of(F.col("segment"), fv.SEGMENT_LABELS)).alias("segment"),
        "leads", "with_phone", "with_email", "with_website", "cities",
        F.when(total, "").otherwise(T.percent(F.col("avg_confidence"))).alias("avg_conf"),
    )


def segment_keys(leads: DataFrame) -> DataFrame:
    """Known segments in their order, then whatever else occurs."""
    known = leads.sparkSession.createDataFrame(
        [(i, s) for i, (s, _) in enumerate(fv.SEGMENT_LABELS)], "place int, segment string"
    )
    others = leads.select(_segment().alias("segment")).distinct().join(
        F.broadcast(known.select("segment")), "segment", "left_anti"
    )
    return known.unionByName(others.withColumn("place", F.lit(len(fv.SEGMENT_LABELS))))


def high_priority(leads: DataFrame, fallback: int = 50) -> DataFrame:
    """Leads with a phone and an e-mail or web site; when there are none, the best ones overall."""
    hot = leads.filter(T.is_filled("phone") & (T.is_filled("email") | T.is_filled("website")))
    best = leads.orderBy(F.desc("confidence_score"), "source_rank", "task", "item").limit(fallback)
    return hot.unionByName(best.filter(~hot.exists()))


def filter_leads(
    leads: DataFrame, category: str | None = None, city: str | None = None, with_phone: bool = False,
    with_email: bool = False, city_contains: str | None = None,
) -> DataFrame:
    """Plain column predicates, so they reach the scan."""
    if category:
        leads = leads.filter(F.col("category") == category)
    if city:
        leads = leads.filter(F.col("city") == city)
    if city_contains:
        leads = leads.filter(F.contains(F.lower("city"), F.lower(F.lit(city_contains))))
    if with_phone:
        leads = leads.filter(F.length("phone") >= 7)
    if with_email:
        leads = leads.filter(F.col("email").rlike(r"^[^@]+@[^@]+\.[^@]+$"))
    return leads


def confidence_tier(score: T.ColumnOrName, high: float = 0.7, medium: float = 0.4) -> Column:
    """Tiers for leads; pass 0.9 and 0.75 for extracted fields."""
    c = T.col(score)
    return F.when(c >= high, "high").when(c >= medium, "medium").otherwise("low")


def split_services(c: T.ColumnOrName) -> Column:
    return F.filter(F.transform(F.split(T.col(c), ","), T.strip), lambda s: s != "")


def lead_view(products: DataFrame) -> DataFrame:
    """Stored product rows (columns plus an extra_meta map) seen as leads, with the fallback chains."""
    def meta(key: str) -> Column:
        return T.blank_to_null(F.try_element_at("extra_meta", F.lit(key)))

    def pick(*choices: Column, default: str = "") -> Column:
        return F.coalesce(*choices, F.lit(default))

    plain = {c: T.blank_to_null(c) for c in ("title", "platform", "brand", "url")}
    return products.select(
        "id", "job_id",
        pick(plain["title"], meta("company_name")).alias("company_name"),
        pick(plain["brand"], meta("category"), default="other").alias("category"),
        pick(meta("city")).alias("city"),
        pick(meta("phone"), meta("mobile")).alias("phone"),
        pick(meta("email")).alias("email"),
        pick(meta("website"), plain["url"]).alias("website"),
        pick(meta("address")).alias("address"),
        pick(meta("description")).alias("description"),
        split_services(pick(meta("services"))).alias("services"),
        pick(plain["platform"], meta("source"), meta("source_platform")).alias("source_platform"),
        pick(meta("source_url"), plain["url"]).alias("source_url"),
        C.confidence_score("rating").alias("confidence_score"),
        "created_at",
        residual_meta("extra_meta").alias("extra_meta"),
    )


def residual_meta(c: T.ColumnOrName) -> Column:
    """Open attributes that have no column of their own."""
    return F.map_filter(T.col(c), lambda k, _: ~k.isin(fv.KNOWN_META_KEYS))


def lead_export(view: DataFrame) -> DataFrame:
    return view.withColumn("services", F.array_join("services", ", ")).drop("extra_meta")


def lead_to_product_row(leads: DataFrame, job_id: str) -> DataFrame:
    """Storage row of a lead, with the declared column widths."""
    def cut(c: str, n: int) -> Column:
        return F.left(T.or_blank(c), F.lit(n))

    extra = ["phone", "mobile", "email", "address", "city", "source"]
    return leads.select(
        F.lit(job_id).alias("job_id"),
        cut("company_name", 200).alias("title"),
        cut("category", 100).alias("brand"),
        cut("source", 100).alias("platform"),
        cut("website", 500).alias("url"),
        F.col("quality_score").cast("double").alias("rating"),
        cut("description", 500).alias("description"),
        F.create_map(*[x for c in extra for x in (F.lit(c), T.or_blank(c))]).alias("extra_meta"),
    )


def lead_report_rows(leads: DataFrame) -> DataFrame:
    """Display columns of the lead sheets."""
    return leads.select(
        "company_name", "phone", "mobile", "email", "website", "address", "category", "city",
        F.initcap(F.replace("source", F.lit("_"), F.lit(" "))).alias("source"),
        F.when(C.has_phone(), "Yes").otherwise("No").alias("has_phone"),
        F.when(T.is_filled("email"), "Yes").otherwise("No").alias("has_email"),
        "quality_score",
        F.concat(F.floor(F.col("confidence_score") * 100).cast("string"), F.lit("%")).alias("conf"),
        confidence_tier("confidence_score").alias("tier"),
        F.left(T.or_blank("description"), F.lit(200)).alias("description"),
    )
