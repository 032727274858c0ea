"""Invoices: document text to header fields, taxes, line items and review flag.

Everything is native regular expressions over the text column, in two projections: raw readings first,
fields built from them second. Nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrawl import fixed_values as fv
from papertrawl.functions import text as T
from papertrawl.functions.dom import bind
from papertrawl.operators.once import compute_once

ENGINE = "invoice_extractor"
#: The pattern, tried only on lines with a currency sign before their end or at the start of what follows.
ITEM_LINE = fv.GENERIC_ITEM.replace("^", r"^(?=(?-U:[^₹\n]*+)(?:₹|\n\s*₹))", 1)
HEADER = ["invoice_number", "invoice_date", "due_date", "vendor", "buyer", "subtotal", "tax", "total"]


def detect_brand(text: T.ColumnOrName) -> Column:
    rules = [(markers, brand) for brand, markers in fv.INVOICE_BRANDS]
    return F.coalesce(T.first_marked(text, rules, whole_words=False), F.lit("generic"))


def _hit(value: Column, confidence: float) -> Column:
    return bind(value, lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(confidence).alias("confidence"))))


def _either(*hits: Column) -> Column:
    """First reading found, else no value with the low confidence."""
    nothing = F.struct(F.lit(None).alias("value"), F.lit(fv.NOT_FOUND).alias("confidence"))
    return F.coalesce(*hits, nothing)


def _brand_hit(field: str) -> Column:
    """The brand's own pattern for a field; brands with equal layouts share one."""
    text, brand = F.col("text"), F.col("brand")
    hits = []
    for brands, fields in ((["amazon"], fv.AMAZON_FIELDS), (["zepto", "blinkit"], fv.ZEPTO_FIELDS),
                           (["flipkart"], fv.FLIPKART_FIELDS)):
        if field in fields:
            pattern, confidence = fields[field]
            value = T.blank_to_null(T.strip(F.substring_index(T.group(text, pattern), "\n", 1)))
            hits.append(F.when(brand.isin(brands), _hit(value, confidence)))
    return F.coalesce(*hits) if hits else F.lit(None)


def _sold_by(text: Column, buyer: Column) -> Column:
    """Seller in front of the buyer's first word on the line after the seller heading."""
    pattern = F.concat(F.lit(fv.AMAZON_SOLD_BY), F.substring_index(buyer, " ", 1))
    found = F.call_function("regexp_extract", text, pattern, F.lit(1))
    return T.blank_to_null(T.strip(F.rtrim(T.strip(found), F.lit("*"))))


def _last_amount(line: Column) -> Column:
    return T.number(T.last(T.groups(line, fv.AMOUNT, 0)))


def _with_percent(text: T.ColumnOrName) -> Column:
    """Rates are read from texts with a percent sign only: each of their patterns ends in one or holds one."""
    return F.contains(T.col(text), F.lit("%"))


def gst_breakdown(text: T.ColumnOrName) -> Column:
    """Central, state and integrated tax amounts and the integrated rate, as far as printed."""
    entries = F.transform(
        T.groups(text, fv.IGST_ENTRY, 0),
        lambda m: F.struct(F.regexp_extract(m, fv.IGST_ENTRY, 1).alias("rate"),
                           T.number(F.regexp_extract(m, fv.IGST_ENTRY, 2)).alias("amount")),
    )
    wanted = F.filter(entries, lambda e: (e["rate"] != "0") & (F.coalesce(e["amount"], F.lit(1.0)) != 0))
    igst = F.when(_with_percent(text), F.get(wanted, 0))
    cgst, sgst = T.number(T.group(text, fv.CGST_AMOUNT)), T.number(T.group(text, fv.SGST_AMOUNT))
    raw = F.struct(igst.alias("igst"), cgst.alias("cgst"), sgst.alias("sgst"))

    def both(x: Column) -> Column:
        return (x["cgst"] != 0) & (x["sgst"] != 0)

    return bind(raw, lambda x: F.struct(
        F.when(both(x), x["cgst"]).alias("cgst_amount"), F.when(both(x), x["sgst"]).alias("sgst_amount"),
        x["igst"]["rate"].alias("igst_rate"), x["igst"]["amount"].alias("igst_amount"),
    ))


def _amazon_total(text: Column) -> Column:
    lines = F.transform(T.groups(text, fv.INVOICE_TOTAL[0]), _last_amount)
    return F.get(F.filter(lines, lambda v: v.isNotNull()), 0)


def _amazon_tax(text: Column) -> Column:
    amounts = F.transform(T.groups(text, fv.AMAZON_TAX_AMOUNTS), T.number)
    total = F.aggregate(amounts, F.lit(0.0), lambda acc, a: acc + F.coalesce(a, F.lit(0.0)))
    return bind(F.round(total, 2), lambda t: F.when(t > 0, t))


def _amazon_rate(text: Column) -> Column:
    return bind(
        T.groups(text, fv.AMAZON_TAX_RATES),
        lambda rates: F.coalesce(F.get(F.filter(rates, lambda r: r != "0"), 0), F.get(rates, 0)),
    )


def _zepto_row(text: Column) -> Column:
    """Taxable value, central and state tax of the totals row; null unless both taxes are there."""
    row = F.get(T.groups(text, fv.ZEPTO_TOTALS_ROW, 0), 0)
    numbers = F.struct(*[
        T.number(F.regexp_extract(row, fv.ZEPTO_TOTALS_ROW, i + 1)).alias(n)
        for i, n in enumerate(("taxable", "cgst", "sgst"))
    ])
    return bind(numbers, lambda x: F.when((x["cgst"] != 0) & (x["sgst"] != 0), x))


def _line_items(text: Column, brand: Column, most: int | None) -> Column:
    """The marketplace table when it matches, else lines with two amounts, each description once; all, or the first few."""
    def item(match: Column, pattern: str, at: dict[str, int]) -> Column:
        """One match to its fields: the groups without blanks first, then the description, which may hold any."""
        parts = F.split(F.regexp_replace(match, pattern, " ".join(f"${n}" for n in [*at.values(), 1])), " ", len(at) + 1)
        return bind(parts, lambda p: F.struct(
            T.strip(F.get(p, len(at))).alias("description"),
            *[(T.number(F.get(p, list(at).index(n))) if n in at else F.lit(1.0)).alias(n) for n in ("quantity", "unit_price", "total")],
            F.lit("quantity" in at).alias("from_table"),
        ))

    table = F.filter(
        F.transform(T.groups(text, fv.AMAZON_ITEM, 0),
                    lambda m: item(m, fv.AMAZON_ITEM, {"unit_price": 2, "quantity": 3, "total": 6})),
        lambda i: (F.length(i["description"]) >= 3) & ~F.upper(i["description"]).isin("TOTAL", "AMOUNT"),
    )

    def rename(i: Column) -> Column:
        return i.withField("description", F.rtrim(i["description"], F.lit(".")))

    def wanted(i: Column) -> Column:
        d = i["description"]
        junk = reduce(or_, [F.contains(F.lower(d), F.lit(w)) for w in fv.NOT_AN_ITEM])
        return (F.length(d) >= 4) & ~d.rlike(r"(?U)^[\d\s.]+$") & ~junk

    lines = F.filter(
        F.transform(T.groups(text, ITEM_LINE, 0),
                    lambda m: rename(item(m, fv.GENERIC_ITEM, {"unit_price": 2, "total": 3}))),
        wanted,
    )

    def first_by_description(found: Column) -> Column:
        return bind(F.transform(found, lambda i: i["description"]), lambda names: F.filter(
            found, lambda i, n: F.array_position(names, i["description"]) == n + 1
        ))

    generic = bind(lines, first_by_description)
    special = F.when(brand == "amazon", table)
    items = bind(special, lambda s: F.when(F.size(s) > 0, s).otherwise(generic))
    return items if most is None else F.slice(items, 1, most)


def read_invoices(docs: DataFrame, most_items: int | None = None) -> DataFrame:
    """(doc_id, text) to raw readings: one row per document, values not yet formatted.

    most_items: keep only the first items of an invoice (fv.MAX_LINE_ITEMS for parity); all by default.
    """
    text, brand = F.col("text"), F.col("brand")
    amazon, zepto = brand == "amazon", brand.isin("zepto", "blinkit")

    def amount(hit: Column) -> Column:
        return bind(hit, lambda h: F.when(
            h.isNotNull(), F.struct(T.number(h["value"]).alias("value"), h["confidence"].alias("confidence"))))

    def known(hit: Column) -> Column:
        return bind(hit, lambda h: F.when(h["value"].isNotNull(), h))

    buyer = _either(
        _brand_hit("buyer"),
        F.when(~amazon, _hit(T.first_group(text, fv.INVOICE_BUYER), 0.87)),
        _hit(T.group(text, fv.INVOICE_BUYER_ANY), 0.86),
    )
    totals = [
        bind(_last_amount(F.regexp_extract(text, p, 1)), lambda v: _hit(F.when(v > 0, v), 0.91))
        for p in fv.INVOICE_TOTAL
    ]
    taxes = [_hit(T.number(T.group(text, p)), 0.86) for p in fv.INVOICE_TAX]
    first = compute_once(docs, {"brand": detect_brand("text")}).withColumns({
        "number": _either(_brand_hit("invoice_number"), _hit(T.first_group(text, fv.INVOICE_NUMBER), fv.FOUND)),
        "order_number": F.coalesce(
            _brand_hit("order_number")["value"],
            F.when(brand == "generic", T.first_group(text, fv.ORDER_NUMBER)),
        ),
        "date": _either(_brand_hit("invoice_date"), _hit(T.first_group(text, fv.INVOICE_DATE), fv.FOUND)),
        "buyer": buyer,
        "gst": gst_breakdown("text"),
        "total": _either(
            F.when(amazon, _hit(_amazon_total(text), fv.AMAZON_TOTAL_CONFIDENCE)),
            known(amount(_brand_hit("total"))), *totals,
        ),
        "zepto_row": F.when(zepto, _zepto_row(text)),
        "items": _line_items(text, brand, most_items),
    })
    gst, row = F.col("gst"), F.col("zepto_row")
    second = first.withColumns({
        "vendor": _either(
            _brand_hit("vendor"),
            F.when(amazon, _hit(_sold_by(text, F.col("buyer.value")), fv.AMAZON_SOLD_BY_CONFIDENCE)),
            _hit(T.first_group(text, fv.INVOICE_VENDOR), 0.88),
        ),
        "tax": _either(
            F.when(amazon, _hit(_amazon_tax(text), fv.AMAZON_TAX_CONFIDENCE)),
            _hit(F.round(row["cgst"] + row["sgst"], 2), fv.ZEPTO_TAX_CONFIDENCE),
            _hit(F.round(gst["cgst_amount"] + gst["sgst_amount"], 2), 0.93),
            _hit(F.when(gst["igst_amount"] > 0, gst["igst_amount"]), 0.91),
            *taxes,
        ),
    })
    tax, total = F.col("tax.value"), F.col("total.value")
    zepto_rate = F.when(
        row["taxable"] > 0, F.round(F.round(row["cgst"] + row["sgst"], 2) / row["taxable"] * 100, 1).cast("string")
    )
    implied = F.round(tax / (total - tax) * 100, 1)
    third = second.withColumn("rate", F.coalesce(
        F.when(amazon, _amazon_rate(text)), zepto_rate,
        F.when(_with_percent(text), T.first_group(text, fv.INVOICE_TAX_RATE)),
        F.when((total > tax) & (implied > 0) & (implied <= 100), implied.cast("string")),
    )).withColumn("subtotal", _either(
        known(amount(_brand_hit("subtotal"))),
        _hit(T.number(T.first_group(text, fv.INVOICE_SUBTOTAL)), fv.FOUND),
        _hit(F.round(total - tax, 2), 0.82),
    ))
    return third.drop("text", "zepto_row")


def tax_display(tax: Column, rate: Column, gst: Column) -> Column:
    """₹0.76 (18%) [IGST 18%: ₹0.76]"""
    return F.concat_ws(
        " ", T.money(tax), F.concat(F.lit("("), rate, F.lit("%)")),
        F.coalesce(
            F.concat(F.lit("[CGST: "), T.money(gst["cgst_amount"]), F.lit(" + SGST: "), T.money(gst["sgst_amount"]), F.lit("]")),
            F.when(gst["igst_amount"] != 0, F.concat(
                F.lit("[IGST "), gst["igst_rate"], F.lit("%: "), T.money(gst["igst_amount"]), F.lit("]")
            )),
        ),
    )


def extract_invoices(docs: DataFrame, most_items: int | None = None) -> DataFrame:
    """(doc_id, text) to one row per invoice with fields, items and review flag."""
    def shown(hit: str, value: Column, present: Column) -> Column:
        return T.field(value, F.when(present, F.col(hit)["confidence"]).otherwise(F.lit(fv.NOT_FOUND)), ENGINE)

    def text_field(hit: str, default: Column) -> Column:
        value = F.col(hit)["value"]
        return shown(hit, F.coalesce(value, default), value.isNotNull())

    def money_field(hit: str) -> Column:
        value = F.col(hit)["value"]
        return shown(hit, F.when(value != 0, T.money(value)), F.coalesce(value != 0, F.lit(False)))

    unknown = F.lit("Unknown")
    items = F.transform("items", lambda i: F.struct(
        T.field(i["description"], F.when(i["from_table"], 0.88).otherwise(0.80), ENGINE).alias("description"),
        T.field(F.when(i["from_table"], T.number_text(F.when(i["quantity"] != 0, i["quantity"]).otherwise(F.lit(1.0))))
                .otherwise("1"), F.when(i["from_table"], 0.94).otherwise(0.70), ENGINE).alias("quantity"),
        T.field(T.number_text(i["unit_price"]), F.when(i["from_table"], 0.91).otherwise(0.82), ENGINE).alias("unit_price"),
        T.field(T.number_text(i["total"]), F.when(i["from_table"], 0.93).otherwise(0.85), ENGINE).alias("total"),
    ))
    review = F.col("number.value").isNull() | F.col("date.value").isNull() | F.col("total.value").isNull()
    return read_invoices(docs, most_items).select(
        "doc_id", "brand", "order_number",
        text_field("number", F.coalesce("order_number", unknown)).alias("invoice_number"),
        text_field("date", F.lit("")).alias("invoice_date"),
        T.field(F.lit(""), F.lit(fv.NOT_FOUND), ENGINE).withField("value", F.lit(None).cast("string")).alias("due_date"),
        text_field("vendor", F.when(F.col("brand") == "amazon", "Amazon.in").otherwise("Unknown")).alias("vendor"),
        text_field("buyer", unknown).alias("buyer"),
        money_field("subtotal").alias("subtotal"),
        shown("tax", tax_display(F.col("tax.value"), F.col("rate"), F.col("gst")), F.col("tax.value").isNotNull()).alias("tax"),
        money_field("total").alias("total"),
        F.col("rate").alias("tax_rate"), "gst", items.alias("line_items"),
        review.alias("human_review_required"),
    )


def invoice_items(invoices: DataFrame) -> DataFrame:
    return invoices.select("doc_id", F.posexplode("line_items").alias("pos", "item")).select(
        "doc_id", (F.col("pos") + 1).alias("item_no"), "item.*"
    )


def split_review(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted results and the review queue."""
    review = F.col("human_review_required")
    return results.filter(~review), results.filter(review)


def percent_of(field: str) -> Column:
    return T.or_blank(T.percent(F.col(field)["confidence"]))


def normalize_invoices(invoices: DataFrame, filename: Column | None = None) -> DataFrame:
    """Flat rows, one per item; header values only on an invoice's first row, a placeholder without items."""
    tax = F.col("tax.value")
    header = {
        "source_file": F.lit("") if filename is None else filename,
        "invoice_number": F.col("invoice_number.value"), "invoice_confidence": percent_of("invoice_number"),
        "invoice_engine": F.col("invoice_number.engine"), "invoice_date": F.col("invoice_date.value"),
        "due_date": T.or_blank(F.col("due_date.value")), "vendor": F.col("vendor.value"), "vendor_confidence": percent_of("vendor"),
        "buyer": F.col("buyer.value"), "subtotal": F.col("subtotal.value"),
        "tax_amount": T.strip(F.regexp_replace(F.regexp_replace(tax, r"\s*\(.*?\)", ""), r"\s*\[.*?\]", "")),
        "tax_percent": F.regexp_extract(tax, r"\((\d+(?:\.\d+)?%)\)", 1),
        "cgst": F.regexp_extract(tax, r"(?i)CGST:\s*(₹[\d,.]+)", 1),
        "sgst": F.regexp_extract(tax, r"(?i)SGST:\s*(₹[\d,.]+)", 1),
        "grand_total": F.col("total.value"), "total_confidence": percent_of("total"),
        "human_review": F.when(F.col("human_review_required"), "Yes").otherwise("No"),
    }
    rows = invoices.select(
        "doc_id", *[c.alias(n) for n, c in header.items()], F.posexplode_outer("line_items").alias("pos", "item")
    )
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    return rows.select(
        "doc_id", *[F.when(first, F.col(n)).otherwise("").alias(n) for n in header],
        (F.col("pos") + 1).alias("item_no"),
        F.coalesce("item.description.value", F.lit("No line items detected")).alias("description"),
        T.or_blank("item.quantity.value").alias("quantity"),
        T.or_blank("item.unit_price.value").alias("unit_price"),
        T.or_blank("item.total.value").alias("line_total"),
    )
