"""Text, number and contact functions against plain Python on the same inputs."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from papertrawl import fixed_values as fv
from papertrawl.functions import contacts as C
from papertrawl.functions import text as T
from papertrawl.sources.tables import table


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def python_phones(text):
    """The same rules with lists: prefixed numbers, then all others, mobiles first."""
    prefixed, anything = (p.removeprefix("(?U)") for p in (fv.PHONE_PREFIXED, fv.PHONE_ANY))
    first = [re.sub(r"\D", "", m)[:10] for m in re.findall(prefixed, text)]
    others = [re.sub(r"^(?:091|91|0)(?=\d{10}$)", "", re.sub(r"\D", "", m)) for m in re.findall(anything, text)]
    kept = [d for d in first if len(d) == 10] + [d for d in others if 8 <= len(d) <= 10]
    return sorted(dict.fromkeys(kept), key=lambda d: not re.fullmatch(r"[6-9]\d{9}", d))


SAMPLES = [
    "call +91 98765 43210 or 022-2345-6789", "0919876543210", "mobile 9876543210, again 9876543210",
    "IP 13.149.130.7", "(040) 2345 6789 and 919812345678", "x98765432109y", "", "none here",
    "080 4123 4567 then +91-7012345678 then 7012345678",
]


def test_phones_samples(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    for row in df.select("s", C.phones("s").alias("p")).collect():
        assert row["p"] == python_phones(row["s"]), row["s"]


def test_phones_whole_documents(spark, sf):
    rows = table(spark, sf, "documents").select("text", C.phones("text").alias("p")).collect()
    assert any(r["p"] for r in rows)
    for row in rows:
        assert row["p"] == python_phones(row["text"])


def test_emails(spark):
    text = "A.B@Firm.in, a.b@firm.in x@example.com logo@2x.png z.y@noreply.org me@site.co.uk"
    assert one(spark, C.emails(F.lit(text))) == ["a.b@firm.in", "me@site.co.uk"]


def test_jsonld_contacts(spark):
    html = (
        '<script type="application/ld+json">{"telephone":"+91 98765 43210","email":"Sales@firm.in",'
        '"phone":{"telephone":"022-2345-6789"}}</script>'
        '<script type="application/ld+json">[{"telephone":9876543211},{"phone":"09812345678"},3]</script>'
        '<script type="application/ld+json">not json</script>'
    )
    blocks = C.jsonld_blocks(F.lit(html))
    assert one(spark, C.jsonld_phones(blocks)) == ["9876543210", "2223456789", "9812345678"]
    assert one(spark, C.jsonld_emails(blocks)) == ["sales@firm.in"]


@pytest.mark.parametrize("raw, clean", [
    ("  Acme   Traders | Home", "Acme Traders"), ("Coca-Cola", "Coca"), ("Foo Bar in New Delhi", "Foo Bar"),
    ("Société Générale", "Société Générale"), ("x" * 200, "x" * 120),
])
def test_clean_name(spark, raw, clean):
    assert one(spark, C.clean_name(F.lit(raw))) == clean


def test_dedup_key_ignores_case_and_punctuation(spark):
    a = one(spark, C.dedup_key(F.lit("Société & Co."), F.lit("Delhi")))
    assert a == one(spark, C.dedup_key(F.lit("SOCIÉTÉ CO"), F.lit("DELHI")))
    assert a == hashlib.md5("sociétéco:delhi".encode()).hexdigest()


@pytest.mark.parametrize("raw, value, glued", [
    ("₹1,299", 1299.0, 1299.0), ("Rs. 999", 999.0, 1.0), ("INR 500", 500.0, 500.0), ("free", None, None),
    ("0", None, None), ("12.50 - 14.00", 12.5, None),
])
def test_price(spark, raw, value, glued):
    assert one(spark, T.price(F.lit(raw))) == value
    assert one(spark, T.price(F.lit(raw), strict_parity=True)) == glued


def test_numbers_and_names(spark):
    assert one(spark, T.number(F.lit("₹1,234.567"))) == 1234.57
    assert one(spark, T.number(F.lit("1.2.3"))) is None
    assert one(spark, T.number_text(F.lit(12345678.9))) == "12345678.9"
    assert one(spark, T.title_case(F.lit("bank-asia 3ab éa"))) == "Bank-Asia 3Ab Éa"
    assert one(spark, T.page_number(F.lit("page0-region-0"))) == 1
    assert one(spark, T.page_number(F.lit("other"))) == 1
    assert one(spark, T.clean_ocr_text(F.lit("a  b\n***\n  c­x  \n₹5"))) == "a b cx ₹5"
    assert one(spark, T.discount(F.lit(80.0), F.lit(100.0))) == 20.0
    assert one(spark, T.discount(F.lit(100.0), F.lit(80.0))) is None
    assert one(spark, T.url_host(F.lit("https://www.a.in:8080/x?y#z"))) == "www.a.in:8080"
    assert one(spark, T.bare_host(F.lit("https://www.wwf.org/"))) == "wwf.org"


def test_patterns_tried_only_where_their_letters_stand(spark):
    fixed = [x for v in vars(fv).values() for x in (v if isinstance(v, list) else [v]) if isinstance(x, str) and x.startswith("(?")]
    changed = [p for p in fixed if T.ahead(p) != p]
    assert len(changed) > 20 and all(T.ahead(p) == p for p in (r"(?i)(\d+)\s*x", r"(?i)(?:ab)?c", r"(?i)a*b", r"(?i)[ab]c", r"(?ix)a b", r"(?i)(?:x|\d)a"))
    texts = ["TAX INVOICE\nInvoice Number : INV-1-2\nDATE: 01/02/2020\nSub Total: 5.00\nSGST 1.5\nTotal Amount: ₹7", "\u017fub total 3 \u017fgst 4",
             "\u0130nvoice Value 9", "b\u0131ll To x\nAnna Lee\n", "\u212aMKT-123 mkt-456", "A/c No: 1234567 tax rate 5%", "gs gst 5% Grand\nTotal 8", "", "i", "IN", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for p in changed:
        found = df.select(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("a"), F.regexp_extract_all("text", F.lit(T.ahead(p)), F.lit(0)).alias("b")).collect()
        assert all(r.a == r.b for r in found), p


def test_letters_that_stand_for_others_where_case_is_ignored(spark):
    chars = spark.range(1, 0x10000).filter("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    letters = "abcdefghijklmnopqrstuvwxyz"
    row = chars.agg(*[F.count_if(F.col("c").rlike(f"(?iU)^{x}$") & ~F.col("c").rlike(f"^{T._one_of(x)}$")).alias(x) for x in letters]).first()
    assert not any(row)
