"""Invoices and statements on small texts."""

from pyspark.sql import functions as F

from papertrawl import fixed_values as fv
from papertrawl.operators import invoices as I
from papertrawl.operators import statements as S

GENERIC = """
INVOICE
Invoice No: QX-77-310
Invoice Date: 09/05/2023
Due Date: 08/06/2023
From: Northern Loom Works
Bill To: Harbour Street Canteen

Belt replacement     2      1250.00      2500.00

Sub Total: 2500.00
GST (18%): 450.00
Total Amount: 2950.00
"""
MARKET = """Tax Invoice/Bill of Supply
Sold By : Billing Address :
Lumen Paperworks Limited Asha Menon
GST Registration No: 29ABCDE1111F1Z5 Asha Menon
Order Number: 171-2233445-9988776
Invoice Number : QKDP-118204
Invoice Date : 04.03.2024
Rivers-Hardcover ₹300.00 ₹0.00 2 ₹600.00 12% IGST ₹72.00 ₹672.00
TOTAL: ₹72.00₹672.00
For Lumen Paperworks Limited:
Authorized Signatory amazon.in
"""
GROCERY = """Seller Name: Zepto Dale Grocers Private Limited
Invoice No.: 250117K020099001
Order No.: ORD-71
Date : 17-01-2025
Bill To Ship To
Asha Menon
Item Total 220.00
200.00 5.00 5.00 0.00 210.00
Invoice Value 210.00
"""


def invoices(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    return I.extract_invoices(df).orderBy("doc_id").collect()


def test_generic_invoice(spark):
    [r] = invoices(spark, GENERIC)
    assert r["brand"] == "generic"
    assert r["invoice_number"]["value"] == "QX-77-310"
    assert r["invoice_date"]["value"] == "09/05/2023"
    assert r["total"]["value"] == "₹2,950.00" and r["total"]["confidence"] == 0.91
    assert r["subtotal"]["value"] == "₹2,500.00"
    assert r["due_date"]["value"] is None and not r["human_review_required"]
    assert r["invoice_number"]["engine"] == "invoice_extractor"


def test_marketplace_invoice(spark):
    [r] = invoices(spark, MARKET)
    assert r["brand"] == "amazon"
    assert (r["invoice_number"]["value"], r["invoice_number"]["confidence"]) == ("QKDP-118204", 0.98)
    assert r["buyer"]["value"].startswith("Asha Menon")
    assert (r["vendor"]["value"], r["vendor"]["confidence"]) == ("Lumen Paperworks Limited", 0.96)
    assert r["order_number"] == "171-2233445-9988776"
    assert r["total"]["value"] == "₹672.00"
    assert r["tax"]["value"] == "₹72.00 (12%) [IGST 12%: ₹72.00]"
    [item] = r["line_items"]
    assert item["description"]["value"] == "Rivers-Hardcover"
    assert (item["quantity"]["value"], item["unit_price"]["value"], item["total"]["value"]) == ("2.0", "300.0", "672.0")


def test_grocery_invoice(spark):
    [r] = invoices(spark, GROCERY)
    assert r["brand"] == "zepto"
    assert r["vendor"]["value"] == "Zepto Dale Grocers Private Limited"
    assert r["buyer"]["value"] == "Asha Menon"
    assert r["total"]["value"] == "₹210.00" and r["subtotal"]["value"] == "₹220.00"
    assert r["tax"]["value"] == "₹10.00 (5.0%)"
    flat = I.normalize_invoices(I.extract_invoices(spark.createDataFrame([(1, GROCERY)], "doc_id int, text string"))).first()
    assert flat["description"] == "No line items detected" and flat["item_no"] is None
    assert (flat["tax_amount"], flat["tax_percent"]) == ("₹10.00", "5.0%")


def test_incomplete_invoices_need_review(spark):
    no_total, no_number, empty = invoices(
        spark, "Invoice No: LK-5\nDate: 02/03/2022\nVendor: Tidal Press", "Invoice Date: 02/03/2022\nTotal Amount: 812.00", ""
    )
    assert no_total["human_review_required"] and no_number["human_review_required"] and empty["human_review_required"]
    assert no_number["invoice_number"]["value"] == "Unknown" and empty["vendor"]["value"] == "Unknown"


def test_items_are_distinct_and_all_kept(spark):
    lines = "\n".join(f"Article number {i % 40} ₹{i}.00 x ₹{i}.50" for i in range(100)) + "\nShipping charges ₹5.00 x ₹5.00\n"
    [r] = invoices(spark, lines)
    names = [i["description"]["value"] for i in r["line_items"]]
    assert names == [f"Article number {i}" for i in range(40)]
    df = spark.createDataFrame([(1, lines)], "doc_id int, text string")
    assert len(I.extract_invoices(df, most_items=30).first()["line_items"]) == 30


HDFC = """
HDFC BANK LIMITED
Account No: 900011223344
IFSC Code: HDFC0007777
Account Holder Name: Asha Menon
Opening Balance: 12,000.00
01/06/2023 Balance brought forward 0.00 0.00 12,000.00
04/06/2023 UPI/LAUNDRY/7 250.00 0.00 11,750.00
09/06/2023 RENT RECEIVED 0.00 8,000.00 19,750.00
Statement Period: 01/06/2023 to 30/06/2023
"""


def test_statement_text(spark):
    df = spark.createDataFrame([(1, HDFC), (2, "RBL Bank Account ABCD0001234 Account No: 1234567890")], "doc_id int, text string")
    first, second = S.statement_results(S.read_text(df)).orderBy("doc_id").collect()
    assert first["bank_name"]["value"] == "HDFC Bank" and first["template_used"] == "hdfc"
    assert first["account_number"]["value"] == "900011223344" and first["ifsc"]["value"] == "HDFC0007777"
    assert first["account_holder"]["value"] == "Asha Menon"
    assert first["opening_balance"]["value"] == "12000.0" and first["closing_balance"]["value"] == "19750.0"
    assert first["statement_period_to"]["value"] == "30/06/2023"
    assert [t["debit"] for t in first["transactions"]] == ["", "250.0", ""]
    assert not first["human_review_required"]
    assert second["template_used"] == "generic" and second["human_review_required"] and not second["is_structured"]


def test_statement_without_transactions_gets_a_placeholder(spark):
    df = spark.createDataFrame([(1, "nothing")], "doc_id int, text string")
    row = S.transaction_sheet(S.read_text(df)).first()
    assert row["narration"] == "No transactions extracted" and row["sl_no"] is None


def test_short_and_header_rows(spark):
    rows = [
        (1, 0, 0, 0, ["Account No: 12345678"]), (1, 0, 0, 1, ["01/02/24", "Narration", "", "", ""]),
        (1, 0, 0, 2, ["01/02/24 XY", "Fee\npaid", "1,000.5", "", "9"]), (1, 0, 0, 3, ["02/02/24", "Rent", "7"]),
        (1, 0, 0, 4, [None, "x", "y"]), (1, 0, 0, 5, ["Total: 1,000.50 7.00"]),
    ]
    df = spark.createDataFrame(rows, "doc_id int, page int, tbl int, row int, cells array<string>")
    got = [tuple(r)[4:] for r in S.row_transactions(df).orderBy("row").collect()]
    assert got == [("01/02/24", "Fee paid", "1000.50", "", "9.00"), ("02/02/24", "Rent", "", "", "7.00")]
    head = S.read_rows(df).first()
    assert (head["account_no"], head["opening_balance"], head["closing_balance"]) == ("12345678", "9.00", "7.00")
    assert (head["total_debit"], head["total_credit"]) == ("1000.5", "7.0")


def test_items_are_found_on_the_same_lines_as_by_the_plain_pattern(spark):
    texts = ["Blue pen ₹5 each ₹10\nno price here\nRed pen \n ₹5 x ₹6\nshort ₹1 ₹2", "Long name\n\n₹3 of\n₹4", "a b c d e ₹1,200.50 x ₹2,400 \n \nNext item ₹1 ₹2 tail",
             "plain\n" * 5 + "Pen, box\u00a0₹2 ₹3", "₹", "no sign", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select(F.regexp_extract_all("text", F.lit(fv.GENERIC_ITEM), F.lit(0)).alias("a"), F.regexp_extract_all("text", F.lit(I.ITEM_LINE), F.lit(0)).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and sum(len(r.a or []) for r in rows) >= 4


def test_brand_words_and_percent_signs_decide_nothing_but_speed(spark):
    text = "Invoice No. AB12\nGST 18%\nBlue pen ₹5 each ₹10\nA b  c item ₹1,000.5 each ₹2\nGrand Total: ₹10\n"
    row = I.read_invoices(spark.createDataFrame([(1, text), (2, text.replace("%", ""))], "doc_id int, text string")).orderBy("doc_id").collect()
    assert [r.rate for r in row] == ["18", None]
    assert [tuple(i)[:4] for i in row[0]["items"]] == [("Blue pen", 1.0, 5.0, 10.0), ("A b  c item", 1.0, 1000.5, 2.0)]
