"""Contact queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrawl.functions import contacts as C
from papertrawl.functions import text as T
from papertrawl.operators import directory as ops
from papertrawl.sources.tables import spread, table


def contact_phones(spark, sf):
    found = ops.contacts(spread(table(spark, sf, "documents")), "doc_id", "text")
    return found.filter("kind = 'phone'").select("doc_id", "rank", F.col("value").alias("phone"))


def contact_emails(spark, sf):
    found = ops.contacts(spread(table(spark, sf, "documents")), "doc_id", "text")
    return found.filter("kind = 'email'").select("doc_id", "rank", F.col("value").alias("email"))


def contact_index(spark, sf):
    found = ops.contacts(spread(table(spark, sf, "documents")), "doc_id", "text")
    return ops.contact_index(found, "doc_id")


def contact_coverage(spark, sf):
    return ops.contact_coverage(spread(table(spark, sf, "documents")), "source", "text")


def page_contacts(spark, sf):
    phone, email = ops.best_contact("html")
    return spread(table(spark, sf, "pages")).select(
        "page_id", T.or_blank(phone).alias("phone"), T.or_blank(email).alias("email")
    )


def ip_like_phones(spark, sf):
    docs = spread(table(spark, sf, "documents"))
    return docs.select("doc_id", "text", F.explode(C.phones("text")).alias("phone")).select(
        "doc_id", "phone", C.looks_like_ip("phone", "text").alias("is_ip_like")
    )


def clean_names(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", C.clean_name("text").alias("name"))


def dedup_keys(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", C.dedup_key("c_name", "c_mktsegment").alias("dedup_key"))


def url_parts(spark, sf):
    return spread(table(spark, sf, "pages")).select(
        "page_id", T.url_host("url").alias("host"), T.bare_host("url").alias("bare_host"),
        T.site_base("url").alias("site"), T.url_path("url").alias("path"),
        C.excluded_host(T.url_host("url")).alias("excluded"),
    )


QUERIES = {f.__name__: f for f in (
    contact_phones, contact_emails, contact_index, contact_coverage, page_contacts, ip_like_phones, clean_names,
    dedup_keys, url_parts,
)}

# RE2 has no look-behind: digit runs are bracketed with two private characters first, so that "no digit
# before" becomes "right after an opening bracket".
_A, _B = "\ue000", "\ue001"
_S = rf"(?:{_B}?[\s\-.]{_A}?)?"
_ANY = (
    rf"(?:(?:\+{_A}91|{_A}?91|{_A}?0){_S}[6-9]\d{_S}\d{{4}}{_S}\d{{4}}"
    rf"|{_A}[6-9]\d{{9}}{_B}"
    rf"|\(?{_A}?\d{{2,4}}{_B}?\)?{_B}?[\s\-.]{_A}\d{{3,4}}{_B}[\s\-.]{_A}\d{{3,4}})"
)


def phone_sql(text: str) -> str:
    """The phone list of a text, in DuckDB."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    runs = f"regexp_replace({text}, '(\\d+)', '{_A}\\1{_B}', 'g')"
    prefixed = (
        rf"list_filter(list_transform(regexp_extract_all({text}, '(?:\+91|91|0)[\s\-.]*([6-9][\d\s\-.]{{9,15}})', 1), "
        rf"lambda m: left({digits}, 10)), lambda d: length(d) = 10)"
    )
    national = (
        "CASE WHEN length(d) = 12 AND d LIKE '91%' THEN d[3:] WHEN length(d) = 11 AND d LIKE '0%' THEN d[2:] "
        "WHEN length(d) = 13 AND d LIKE '091%' THEN d[4:] ELSE d END"
    )
    others = (
        f"list_filter(list_transform(list_transform(regexp_extract_all({runs}, '{_ANY}', 0), lambda m: {digits}), "
        f"lambda d: {national}), lambda d: length(d) BETWEEN 8 AND 10)"
    )
    return f"list_concat({prefixed}, {others})"


def phone_rows_sql(source: str, key: str, text: str) -> str:
    """(key, phone, rank) rows in DuckDB."""
    return f"""
      SELECT {key}, phone, row_number() OVER (PARTITION BY {key} ORDER BY landline, pos) AS rank FROM (
        SELECT {key}, phone, min(pos) AS pos,
               NOT (length(phone) = 10 AND regexp_matches(phone, '^[6-9]')) AS landline
        FROM (SELECT {key}, unnest(l) AS phone, unnest(range(len(l))) AS pos
              FROM (SELECT {key}, {phone_sql(text)} AS l FROM {source}))
        GROUP BY {key}, phone)"""


def email_rows_sql(source: str, key: str, text: str) -> str:
    return rf"""
      SELECT {key}, email, row_number() OVER (PARTITION BY {key} ORDER BY pos) AS rank FROM (
        SELECT {key}, lower(raw) AS email, min(pos) AS pos
        FROM (SELECT {key}, unnest(l) AS raw, unnest(range(len(l))) AS pos
              FROM (SELECT {key}, regexp_extract_all({text}, '[a-zA-Z0-9._%+\-]{{2,}}@[a-zA-Z0-9.\-]+\.[a-zA-Z]{{2,7}}', 0) AS l
                    FROM {source}))
        GROUP BY {key}, lower(raw))
      WHERE NOT regexp_matches(email, '\.(png|jpg|jpeg|gif|svg|webp|css|js|woff2?)$')
        AND NOT regexp_matches(email, '@(sentry\.|example\.|test\.|domain\.|email\.|noreply|no-reply|yoursite|yourcompany|yourdomain|localhost)')"""


_P, _E = phone_rows_sql("documents", "doc_id", "text"), email_rows_sql("documents", "doc_id", "text")
_HOST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)"

ORACLES = {
    "contact_phones": f"SELECT doc_id, rank, phone FROM ({_P})",
    "contact_emails": f"SELECT doc_id, rank, email FROM ({_E})",
    "contact_index": f"""
      SELECT kind, value, count(*) AS documents, min(doc_id) AS first_document FROM (
        SELECT 'phone' AS kind, phone AS value, doc_id FROM ({_P})
        UNION ALL SELECT 'email', email, doc_id FROM ({_E})) GROUP BY ALL""",
    "contact_coverage": f"""
      WITH p AS (SELECT DISTINCT doc_id FROM ({_P})), e AS (SELECT DISTINCT doc_id FROM ({_E}))
      SELECT source, count(*) AS documents, count(p.doc_id) AS with_phone, count(e.doc_id) AS with_email,
             count(CASE WHEN p.doc_id IS NOT NULL AND e.doc_id IS NOT NULL THEN 1 END) AS with_both
      FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN e ON d.doc_id = e.doc_id GROUP BY source""",
    "page_contacts": f"""
      WITH p AS (SELECT * FROM ({phone_rows_sql("pages", "page_id", "html")}) WHERE rank = 1),
           e AS (SELECT * FROM ({email_rows_sql("pages", "page_id", "html")}) WHERE rank = 1)
      SELECT g.page_id, coalesce(phone, '') AS phone, coalesce(email, '') AS email
      FROM pages g LEFT JOIN p ON g.page_id = p.page_id LEFT JOIN e ON g.page_id = e.page_id""",
    "ip_like_phones": rf"""
      SELECT x.doc_id, phone,
             len(list_filter(regexp_extract_all(text, '\d{{1,3}}(?:\.\d{{1,3}}){{3}}', 0),
                             lambda q: contains(replace(q, '.', ''), phone))) > 0 AS is_ip_like
      FROM ({_P}) x JOIN documents d ON x.doc_id = d.doc_id""",
    "clean_names": r"""
      SELECT conv_id, turn, left(trim(regexp_replace(
        regexp_replace(regexp_replace(text, '\s*[-–|]\s*.*$', '', 'g'),
                       '(?i)\s+(in|at|located in)\s+[\pL\pN_][\pL\pN_\s]{0,30}$', '', 'g'),
        '\s+', ' ', 'g')), 120) AS name FROM conversations""",
    "dedup_keys": r"""
      SELECT c_custkey, md5(left(regexp_replace(lower(c_name), '[^\pL\pN_]+', '', 'g'), 40) || ':' ||
                            lower(c_mktsegment)) AS dedup_key FROM customer""",
    "url_parts": f"""
      SELECT page_id, {_HOST} AS host, regexp_replace({_HOST}, '^www\\.', '') AS bare_host,
             regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+)', 1) AS site,
             CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/'
                  ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1) END AS path,
             regexp_matches({_HOST}, 'bing\\.com|microsoft\\.com|msn\\.com|live\\.com|youtube\\.com|facebook\\.com|wikipedia\\.org|twitter\\.com|x\\.com|instagram\\.com') AS excluded
      FROM pages""",
}
