"""Bank statements: text or table rows to account header and transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrawl import fixed_values as fv
from papertrawl.functions import text as T
from papertrawl.functions.dom import bind
from papertrawl.operators.invoices import percent_of

ENGINE, ROW_ENGINE = "bank_extractor", "table_extractor"
_TX = ["date", "narration", "debit", "credit", "balance"]


def detect_bank(text: T.ColumnOrName, whole_words: bool = True) -> Column:
    """Bank by markers, then by the web host in the text, else unknown.

    Short markers count as whole words; whole_words=False also finds them inside other words.
    """
    host = T.group(text, fv.BANK_WEB_HOST)
    name = T.strip(F.replace(F.replace(host, F.lit("-"), F.lit(" ")), F.lit("bd"), F.lit("")))
    by_host = bind(T.title_case(name), lambda n: F.when(F.length(n) > 2, n))
    return F.coalesce(T.first_marked(text, fv.BANKS, whole_words), by_host, F.lit("Unknown Bank"))


def detect_currency(text: T.ColumnOrName, whole_words: bool = True) -> Column:
    return F.coalesce(T.first_marked(text, fv.CURRENCIES, whole_words), F.lit("INR"))


def _amount_text(c: Column) -> Column:
    return T.or_blank(T.number_text(T.number(c)))


def _non_zero_text(c: Column) -> Column:
    """Blank for zero."""
    return bind(T.number(c), lambda n: T.or_blank(T.number_text(F.when(n != 0, n))))


def transactions_of(text: T.ColumnOrName, narration_chars: int | None = None) -> Column:
    """All lines of date, narration, debit, credit and balance, in order; narrations whole, or cut (150 for parity)."""
    def read(m: Column) -> Column:
        part = {n: F.regexp_extract(m, fv.TRANSACTION, i + 1) for i, n in enumerate(_TX)}
        narration = T.strip(part["narration"])
        return F.struct(
            T.strip(part["date"]).alias("date"),
            (narration if narration_chars is None else F.left(narration, F.lit(narration_chars))).alias("narration"),
            *[_non_zero_text(part[n]).alias(n) for n in ("debit", "credit", "balance")],
        )

    return F.transform(T.groups(text, fv.TRANSACTION, 0), read)


def read_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to header readings and transactions. Row-local."""
    t = F.col("text")
    first = docs.select(
        "doc_id",
        detect_bank(t).alias("bank_name"), detect_currency(t).alias("currency"),
        T.or_blank(T.first_group(t, fv.ACCOUNT_NUMBER)).alias("account_no"),
        T.or_blank(T.group(t, fv.ACCOUNT_HOLDER)).alias("account_holder"),
        T.group(t, fv.IFSC).alias("ifsc"),
        T.or_blank(T.group(t, fv.PERIOD, 1)).alias("period_from"),
        T.or_blank(T.group(t, fv.PERIOD, 2)).alias("period_to"),
        _amount_text(T.group(t, fv.OPENING_BALANCE)).alias("opening_balance"),
        _amount_text(T.group(t, fv.CLOSING_BALANCE)).alias("closing_balance"),
        transactions_of(t).alias("transactions"),
        F.coalesce(*[
            F.when(F.lower(t).rlike(T.marker_pattern(words, True)), F.struct(F.lit(name).alias("name"), F.lit(bank).alias("bank")))
            for name, words, bank in fv.STATEMENT_TEMPLATES
        ]).alias("template"),
    )

    def brought(tx: Column) -> Column:
        n = F.lower(tx["narration"])
        return F.contains(n, F.lit("balance")) & F.contains(n, F.lit("brought"))

    carried = T.last(F.filter("transactions", brought))["balance"]
    # a bank's own template only counts when it leads to transactions
    by_template = F.col("template").isNotNull() & (F.size("transactions") > 0)
    return first.select(
        "doc_id",
        F.when(by_template, F.col("template.bank")).otherwise(F.col("bank_name")).alias("bank_name"),
        "currency", "account_no", "account_holder",
        F.coalesce("ifsc", F.when(F.col("currency") != "INR", "N/A").otherwise("")).alias("ifsc"),
        "period_from", "period_to",
        F.coalesce(carried, F.col("opening_balance")).alias("opening_balance"),
        F.coalesce(T.blank_to_null("closing_balance"), T.last(F.col("transactions"))["balance"], F.lit("")).alias("closing_balance"),
        F.lit("").alias("total_debit"), F.lit("").alias("total_credit"),
        "transactions", (F.size("transactions") > 0).alias("is_structured"),
        F.lit("regex").alias("method"),
        F.when(by_template, F.col("template.name")).otherwise("generic").alias("template_used"),
    )


def _cell(n: int) -> Column:
    return T.or_blank(F.get("cells", n))


def row_transactions(rows: DataFrame) -> DataFrame:
    """Table rows that are transactions: a date in the first cell, at least three cells. Row-local."""
    def two_decimals(c: Column) -> Column:
        return T.or_blank(T.number(c).cast("decimal(30,2)").cast("string"))

    n = F.size("cells")
    narration = T.strip(F.replace(_cell(1), F.lit("\n"), F.lit(" ")))
    first_cell = T.strip(_cell(0))
    dated = first_cell.rlike(r"^\d{2}/\d{2}/\d{2}")
    return (
        rows.filter(dated & (n >= 3))
        .select(
            "doc_id", "page", "tbl", "row",
            F.left(first_cell, F.lit(8)).alias("date"), narration.alias("narration"),
            F.when(n >= 4, two_decimals(_cell(2))).otherwise("").alias("debit"),
            F.when(n >= 4, two_decimals(_cell(3))).otherwise("").alias("credit"),
            F.when(n >= 5, two_decimals(_cell(4))).when(n == 3, two_decimals(_cell(2))).otherwise("").alias("balance"),
        )
        .filter(~F.lower("narration").isin(fv.TABLE_HEADER_WORDS))
    )


def header_text(rows: DataFrame) -> DataFrame:
    """Text of each document's other rows, in order. Only these rows are gathered per document."""
    first_cell = T.strip(_cell(0))
    other = rows.filter((first_cell != "") & ((F.size("cells") < 3) | ~first_cell.rlike(r"^\d{2}/\d{2}/\d{2}")))
    lines = F.array_sort(F.collect_list(F.struct("page", "tbl", "row", first_cell.alias("line"))))
    return other.groupBy("doc_id").agg(
        F.concat(F.array_join(F.transform(lines, lambda r: r["line"]), "\n"), F.lit("\n")).alias("text")
    )


def _bounds(tx: DataFrame) -> DataFrame:
    """First and last transaction of every document, combined before the shuffle."""
    place = F.struct("page", "tbl", "row")
    seen = F.struct("date", "balance")
    return tx.groupBy("doc_id").agg(
        F.min_by(seen, place).alias("first"), F.max_by(seen, place).alias("last"),
        F.count(F.lit(1)).alias("transaction_count"),
    )


def read_rows(rows: DataFrame) -> DataFrame:
    """Table rows to header readings per document; transactions stay in their own table."""
    t = F.col("text")
    read = header_text(rows).select(
        "doc_id", detect_bank(t).alias("bank_name"), detect_currency(t).alias("currency"),
        T.or_blank(T.group(t, fv.TABLE_ACCOUNT_NUMBER)).alias("account_no"),
        T.or_blank(T.first_group(t, fv.TABLE_HOLDER)).alias("account_holder"),
        T.group(t, fv.TABLE_IFSC).alias("ifsc"),
        T.group(t, fv.TABLE_PERIOD, 1).alias("p_from"), T.group(t, fv.TABLE_PERIOD, 2).alias("p_to"),
        _amount_text(T.group(t, fv.TABLE_TOTALS, 1)).alias("total_debit"),
        _amount_text(T.group(t, fv.TABLE_TOTALS, 2)).alias("total_credit"),
    )
    joined = _bounds(row_transactions(rows)).join(read, "doc_id", "left")
    return joined.select(
        "doc_id", F.coalesce("bank_name", F.lit("Unknown Bank")).alias("bank_name"),
        F.coalesce("currency", F.lit("INR")).alias("currency"),
        T.or_blank("account_no").alias("account_no"), T.or_blank("account_holder").alias("account_holder"),
        F.coalesce("ifsc", F.when(F.col("currency") != "INR", "N/A").otherwise("")).alias("ifsc"),
        F.coalesce("p_from", "first.date").alias("period_from"), F.coalesce("p_to", "last.date").alias("period_to"),
        F.col("first.balance").alias("opening_balance"), F.col("last.balance").alias("closing_balance"),
        T.or_blank("total_debit").alias("total_debit"), T.or_blank("total_credit").alias("total_credit"),
        "transaction_count", F.lit(True).alias("is_structured"), F.lit("table_extraction").alias("method"),
        F.lit("table_extraction").alias("template_used"),
    )


def supplement_header(from_rows: DataFrame, from_text: DataFrame) -> DataFrame:
    """Holder and period missing in the table reading are taken from the text reading."""
    gaps = ["account_holder", "period_from", "period_to"]
    other = from_text.select("doc_id", *[F.col(c).alias(f"_{c}") for c in gaps])
    return from_rows.join(other, "doc_id", "left").select(*[
        T.or_blank(F.coalesce(T.blank_to_null(c), F.col(f"_{c}"))).alias(c) if c in gaps else F.col(c)
        for c in from_rows.columns
    ])


def statement_results(read: DataFrame) -> DataFrame:
    """Header fields with confidences and the review flag."""
    has_tx = F.col("transaction_count") > 0 if "transaction_count" in read.columns else F.size("transactions") > 0

    def sure(condition: Column, yes: float, no: float) -> Column:
        return F.when(condition, yes).otherwise(no)

    def f(c: str, confidence: Column) -> Column:
        return T.field(F.col(c), confidence, ENGINE)

    known_bank = F.col("bank_name") != "Unknown Bank"
    keep = [c for c in ("transactions", "transaction_count") if c in read.columns]
    return read.select(
        "doc_id", "currency",
        f("account_no", sure(T.is_filled("account_no"), 0.97, 0.3)).alias("account_number"),
        f("ifsc", sure(T.is_filled("ifsc") & (F.col("ifsc") != "N/A"), 0.92, 0.5)).alias("ifsc"),
        f("bank_name", sure(known_bank, 0.95, 0.3)).alias("bank_name"),
        f("account_holder", sure(T.is_filled("account_holder"), 0.91, 0.3)).alias("account_holder"),
        f("opening_balance", sure(T.is_filled("opening_balance"), 0.88, 0.4)).alias("opening_balance"),
        f("closing_balance", sure(T.is_filled("closing_balance"), 0.90, 0.4)).alias("closing_balance"),
        f("period_from", F.lit(0.88)).alias("statement_period_from"),
        f("period_to", F.lit(0.88)).alias("statement_period_to"),
        *keep, "template_used", "is_structured",
        (~T.is_filled("account_no") | ~has_tx | ~T.is_filled("account_holder")).alias("human_review_required"),
    )


def _booked(c: Column) -> Column:
    """Missing and zero amounts read "0"."""
    return F.when(F.coalesce(T.number(c), F.lit(0.0)) == 0, "0").otherwise(c)


def transaction_fields(tx: DataFrame) -> DataFrame:
    return tx.select(
        *[c for c in tx.columns if c not in _TX],
        T.field(F.col("date"), F.lit(0.94), ROW_ENGINE).alias("date"),
        T.field(F.col("narration"), F.lit(0.92), ROW_ENGINE).alias("narration"),
        T.field(_booked(F.col("debit")), F.lit(0.93), ROW_ENGINE).alias("debit"),
        T.field(_booked(F.col("credit")), F.lit(0.93), ROW_ENGINE).alias("credit"),
        T.field(F.col("balance"), F.lit(0.94), ROW_ENGINE).alias("balance"),
    )


def text_transactions(read: DataFrame) -> DataFrame:
    """One row per transaction of text statements, numbered from 1; numbering needs no shuffle."""
    return read.select("doc_id", F.posexplode("transactions").alias("pos", "tx")).select(
        "doc_id", (F.col("pos") + 1).alias("tx_no"), "tx.*"
    )


def transaction_sheet(read: DataFrame, filename: Column | None = None) -> DataFrame:
    """Numbered display rows; statements without transactions get a placeholder."""
    name = F.lit("") if filename is None else filename
    return read.select("doc_id", name.alias("source_file"), F.posexplode_outer("transactions").alias("pos", "tx")).select(
        "doc_id", (F.col("pos") + 1).alias("sl_no"), "source_file", T.or_blank("tx.date").alias("date"),
        F.coalesce("tx.narration", F.lit("No transactions extracted")).alias("narration"),
        *[F.when(F.col("tx").isNull(), "").otherwise(_booked(F.col(f"tx.{c}"))).alias(c) for c in ("debit", "credit")],
        T.or_blank("tx.balance").alias("balance"),
    )


def summary_sheet(results: DataFrame, filename: Column | None = None) -> DataFrame:
    """Twelve (field, value, confidence, source) rows per statement."""
    def row(no: int, label: str, c: str, engine: bool = True) -> Column:
        return F.struct(
            F.lit(no).alias("line"), F.lit(label).alias("field"), F.col(c)["value"].alias("value"),
            percent_of(c).alias("confidence"), (F.col(c)["engine"] if engine else F.lit("")).alias("source"),
        )

    def plain(no: int, label: str, value: Column) -> Column:
        blank = F.lit("")
        return F.struct(F.lit(no).alias("line"), F.lit(label).alias("field"), value.alias("value"),
                        blank.alias("confidence"), blank.alias("source"))

    def yes(c: str) -> Column:
        return F.when(F.col(c), "Yes").otherwise("No")

    return results.select("doc_id", F.inline(F.array(
        plain(1, "Source File", F.lit("") if filename is None else filename),
        row(2, "Bank Name", "bank_name"), row(3, "Account Holder", "account_holder"),
        row(4, "Account Number", "account_number"), row(5, "IFSC Code", "ifsc"),
        row(6, "Opening Balance", "opening_balance"), row(7, "Closing Balance", "closing_balance"),
        row(8, "Statement From", "statement_period_from", False), row(9, "Statement To", "statement_period_to", False),
        plain(10, "Template Used", F.coalesce(T.blank_to_null("template_used"), F.lit("Generic"))),
        plain(11, "Is Structured", yes("is_structured")), plain(12, "Human Review Required", yes("human_review_required")),
    )))


def parsed_date(c: T.ColumnOrName) -> Column:
    """A date column next to the printed text, whichever of the usual layouts it has."""
    layouts = ["d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d/M/yy"]
    return F.coalesce(*[F.try_to_timestamp(T.col(c), F.lit(f)).cast("date") for f in layouts])
