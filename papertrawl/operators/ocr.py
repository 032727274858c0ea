"""OCR results: engine choice per region, page text, metrics and reports."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from papertrawl import fixed_values as fv
from papertrawl.functions import text as T
from papertrawl.operators.ranking import number_rows
from papertrawl.session import ship_with_tasks

ship_with_tasks(__name__)

REGION = ["doc_id", "page", "region"]
#: Fields of a word; texts need the first two.
WORD = ("word_idx", "text", "confidence", "x", "y", "width", "height")
#: Rows that are packed at a time, at least.
PACKED_ROWS = 16384


def map_layout_class(name: T.ColumnOrName) -> Column:
    known = F.create_map(*[F.lit(x) for pair in fv.LAYOUT_CLASSES for x in pair])
    return F.coalesce(known[T.col(name)], F.lit("text"))


def scale_box(box: Column, width: Column, height: Column, dx: Column | None = None, dy: Column | None = None) -> Column:
    """Unit-square box to pixels of a page or region, shifted by the region's own corner."""
    zero = F.lit(0.0)
    return F.struct(
        (box["x"] * width + (zero if dx is None else dx)).alias("x"),
        (box["y"] * height + (zero if dy is None else dy)).alias("y"),
        (box["width"] * width).alias("width"), (box["height"] * height).alias("height"),
    )


def pad_box(box: Column, width: Column, height: Column, pad: int = 5) -> Column:
    """Pixel corners of a unit-square box with padding, kept inside the page."""
    def low(c: Column, size: Column) -> Column:
        return F.greatest(F.lit(0), F.floor(c * size).cast("int") - pad)

    def high(c: Column, size: Column) -> Column:
        return F.least(size.cast("int"), F.floor(c * size).cast("int") + pad)

    return F.struct(
        low(box["x"], width).alias("x1"), low(box["y"], height).alias("y1"),
        high(box["x"] + box["width"], width).alias("x2"), high(box["y"] + box["height"], height).alias("y2"),
    )


def drop_small_regions(regions: DataFrame, least: int = 10) -> DataFrame:
    """Regions whose padded box (x1, y1, x2, y2) is under ten pixels either way."""
    return regions.filter(
        (F.col("box.x2") - F.col("box.x1") >= least) & (F.col("box.y2") - F.col("box.y1") >= least)
    )


def pack_words(words: DataFrame, fields: Sequence[str] = WORD) -> DataFrame:
    """Words of one region and engine that a task reads one after another, as one row: their fields as arrays, the sum of
    their confidences and its count. Nothing is shuffled; a region read in several places is several rows.
    """
    keys, types = [*REGION, "engine", "region_type"], words.schema
    schema = S.StructType([types[k] for k in keys] + [S.StructField("sum", S.DecimalType(38, 6)), S.StructField("n", S.LongType())] + [
        S.StructField(f, S.ArrayType(types[f].dataType)) for f in fields])

    def pack(read: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(read)
        rows = rows.set_column(len(keys), "exact", rows["exact"].cast(pa.decimal128(38, 6)))
        packed = rows.group_by(keys, use_threads=False).aggregate(
            [("exact", "sum"), ("exact", "count"), *[(f"w_{f}", "list") for f in fields]])
        names = [*keys, "exact_sum", "exact_count", *[f"w_{f}_list" for f in fields]]
        yield from packed.select(names).rename_columns(schema.names).combine_chunks().to_batches()

    def pack_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: list[pa.RecordBatch] = []
        for batch in batches:
            read.append(batch)
            if sum(b.num_rows for b in read) >= PACKED_ROWS:
                yield from pack(read)
                read = []
        if read:
            yield from pack(read)

    exact = F.col("confidence").cast("decimal(18,6)").alias("exact")
    return words.select(*keys, exact, *[F.col(f).alias(f"w_{f}") for f in fields]).mapInArrow(pack_all, schema)


def exact_sum(value: Column) -> tuple[Column, Column]:
    """Sum of doubles as decimals of six digits, whatever their order, and how many there are.

    Usual ones are counted in millionths, as whole numbers; those that are large, or near the middle between two millionths,
    go through decimals, which take many times longer.
    """
    millionths = value * 1e6
    usual = F.coalesce((F.abs(millionths) < 1e9) & (F.abs(millionths - F.rint(millionths)) < 0.25), F.lit(False))
    whole = F.when(usual, F.rint(millionths).cast("bigint"))
    rest = F.when(~usual, value.cast("decimal(18,6)"))
    nothing = F.lit(0).cast("decimal(28,6)")
    # a sum of nothing is null, as sums are
    counted = F.sum(whole).cast("decimal(28,0)") * F.lit(Decimal("0.000001"))
    total = F.when(F.count(whole) + F.count(rest) > 0, (F.coalesce(counted, nothing) + F.coalesce(F.sum(rest), nothing)).cast("decimal(28,6)"))
    return total, F.count(whole) + F.count(rest)


def engine_regions(words: DataFrame, with_words: bool = True, fields: Sequence[str] = WORD) -> DataFrame:
    """One row per region with a map from every engine that read it to its average confidence and words.

    The only shuffle of words: they are packed where they are read and dealt by region, which both groupings can use. Any
    number of engines. fields: what is kept of a word, the first ones of WORD. Words stay packed, as parts: only those of
    the chosen engine are put in order.
    with_words=False: the number of words and the characters of their text take the place of the words; these combine
    before the shuffle, so no word is shuffled.
    """
    if with_words:
        dealt, total, n = pack_words(words, fields).repartition(*REGION), F.sum("sum"), F.sum("n")
        content = [F.collect_list(F.struct(*fields)).alias("parts")]
    else:
        exact, count = exact_sum(F.col("confidence"))
        # blank words are left out, the others joined by blanks; most begin with a visible character, else a pattern looks for one
        visible = (F.col("text") >= "!") & (F.col("text") < "\x7f") | F.col("text").rlike(f"[^{re.escape(fv.WHITESPACE)}]")
        size = F.when(visible, F.length("text"))
        # numbers alone are summed in place: a highest string would have all words sorted first
        dealt = words.groupBy(*REGION, "engine", "region_type").agg(
            exact.alias("sum"), count.alias("n"), F.count(F.lit(1)).alias("tokens"),
            F.sum(size).alias("size"), F.count(size).alias("filled")).repartition(*REGION)
        total, n = F.sum("sum"), F.sum("n")
        characters = F.coalesce(F.sum("size"), F.lit(0)) + F.greatest(F.sum("filled") - 1, F.lit(0))
        content = [F.sum("tokens").cast("int").alias("tokens"), characters.cast("int").alias("characters")]
    confidence = F.try_divide(total.cast("double"), n.cast("double")).alias("confidence")
    read = dealt.groupBy(*REGION, "engine").agg(
        F.max("region_type").alias("region_type"), F.struct(confidence, *content).alias("reading"))
    return read.groupBy(*REGION).agg(
        F.max("region_type").alias("region_type"),
        F.map_from_entries(F.collect_list(F.struct("engine", "reading"))).alias("engines"),
    )


def word_confidence(words: DataFrame) -> DataFrame:
    return words.groupBy(*REGION, "engine").agg(
        (F.sum(F.col("confidence").cast("decimal(18,6)")).cast("double") / F.count(F.lit(1))).alias("confidence"),
        F.count(F.lit(1)).alias("words"),
    )


def select_engine(by_region: DataFrame, ensemble: bool = True, order: Sequence[str] = tuple(fv.OCR_ENGINES)) -> DataFrame:
    """The engine each region is read by: (doc_id, page, region, region_type, engine, confidence, words).

    order: engines by precedence. Tables use the first engine. Other regions use the better of the first two, the
    first one on ties; below 0.75 the best of all other engines is used when it is better still, on ties the earlier
    in the order, engines outside of it last and by name. Regions without words drop out. Of regions without their
    words (see engine_regions) the columns tokens and characters take the place of words.
    """
    def side(name: str) -> Column:
        reading = F.try_element_at("engines", F.lit(name))
        return F.struct(F.lit(name).alias("engine"), F.coalesce(reading["confidence"], F.lit(0.0)).alias("confidence"))

    first, second, *_ = order
    table = F.col("region_type") == "table"
    better = F.lit(ensemble) & ~table & (side(second)["confidence"] > side(first)["confidence"])
    place = lambda name: F.array_position(F.lit(list(order)), name)
    others = F.transform(
        F.filter(F.map_entries("engines"), lambda e: ~e["key"].isin(first, second)),
        lambda e: F.struct((-e["value"]["confidence"]).alias("down"),
                           F.when(place(e["key"]) > 0, place(e["key"])).otherwise(len(order) + 1).alias("place"),
                           e["key"].alias("engine")))
    chosen = by_region.withColumn("_c", F.when(better, side(second)).otherwise(side(first))).withColumn("_other", F.array_min(others))
    weak = ~table & (F.col("_c.confidence") < fv.OCR_RETRY_BELOW) & (-F.col("_other.down") > F.col("_c.confidence"))
    retried = F.struct(F.col("_other.engine").alias("engine"), (-F.col("_other.down")).alias("confidence"))
    chosen = chosen.withColumn("_c", F.when(weak, retried).otherwise(F.col("_c")))
    reading = F.try_element_at("engines", F.col("_c.engine"))
    types = by_region.schema["engines"].dataType.valueType
    content = {c: reading[c] for c in types.names if c not in ("confidence", "parts")}
    if "parts" in types.names:
        fields = types["parts"].dataType.elementType.names
        content["words"] = F.sort_array(F.flatten(F.transform(reading["parts"], lambda p: F.arrays_zip(*[p[f].alias(f) for f in fields]))))
    return chosen.select(
        *REGION, "region_type", F.col("_c.engine").alias("engine"), F.col("_c.confidence").alias("confidence"),
        *[c.alias(name) for name, c in content.items()],
    ).filter(F.size("words") > 0 if "words" in content else F.col("tokens") > 0)


def region_rollup(chosen: DataFrame) -> DataFrame:
    """Text, counts and fallback flag of every region; without text and words if the regions come without words."""
    whole = "words" in chosen.columns
    if whole:
        texts = F.filter(F.transform("words", lambda w: w["text"]), lambda t: T.strip(t) != "")
        chosen = chosen.withColumn("text", F.array_join(texts, " "))
    return chosen.select(
        *REGION, F.format_string("page%d-region-%d", F.col("page"), F.col("region")).alias("region_id"),
        "region_type", "engine", "confidence", *(["text"] if whole else []),
        (F.size("words") if whole else F.col("tokens")).alias("tokens"),
        (F.length("text") if whole else F.col("characters")).alias("characters"),
        ((F.col("confidence") < fv.OCR_FALLBACK_BELOW) & (F.col("engine") != "tesseract")).alias("fallback"),
        *(["words"] if whole else []),
    )


def document_metrics(regions: DataFrame) -> DataFrame:
    """Counts and mean region confidence per document; primary engine = most regions, first seen on ties."""
    place = F.struct("page", "region")
    per_engine = regions.groupBy("doc_id", "engine").agg(
        F.count(F.lit(1)).alias("n"), F.min(place).alias("seen"),
        F.sum(F.col("confidence").cast("decimal(18,9)")).alias("conf"), F.sum("characters").alias("chars"),
        F.sum("tokens").alias("tokens"), F.bool_or("fallback").alias("fallback"), F.max("page").alias("last_page"),
    )
    return per_engine.groupBy("doc_id").agg(
        F.min(F.struct((-F.col("n")).alias("down"), "seen", "engine")).alias("top"),
        F.sum("n").alias("regions"), F.sum("conf").alias("conf"), F.sum("chars").alias("characters_extracted"),
        F.sum("tokens").alias("tokens"), F.bool_or("fallback").alias("fallback_triggered"),
        (F.max("last_page") + 1).alias("page_count"),
    ).select(
        "doc_id", "page_count", F.col("top.engine").alias("engine_used"), "fallback_triggered", "characters_extracted",
        "regions", "tokens", F.round(F.col("conf") / F.col("regions"), 4).cast("double").alias("avg_confidence"),
    )


def page_full_text(regions: DataFrame) -> DataFrame:
    """Cleaned text per page in region order; blank regions are left out."""
    clean = regions.withColumn("clean", T.clean_ocr_text("text")).filter(F.col("clean") != "")
    lines = F.array_sort(F.collect_list(F.struct("region", "clean")))
    return clean.groupBy("doc_id", "page").agg(
        F.array_join(F.transform(lines, lambda r: r["clean"]), " ").alias("page_text")
    )


def document_text(regions: DataFrame, separator: str = "\n") -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("page", "region", "text")))
    return regions.filter(T.strip("text") != "").groupBy("doc_id").agg(
        F.array_join(F.transform(lines, lambda r: r["text"]), separator).alias("text")
    )


def reading_order(regions: DataFrame) -> DataFrame:
    """Top to bottom in tenths of the page, then left to right; halves round to even."""
    banded = regions.withColumn("band", F.rint(F.col("y") * 10))
    return number_rows(banded, ["doc_id", "page"], ["band", "x", "region"], "reading_no")


def region_report(regions: DataFrame) -> DataFrame:
    """One row per region; the cleaned text and its length as far as the regions come with text."""
    clean = T.clean_ocr_text("text")
    text = [F.length(clean).alias("characters"), F.left(clean, F.lit(500)).alias("clean_text")] if "text" in regions.columns else []
    return regions.select(
        "doc_id", "region_id", T.page_number("region_id").alias("page_no"), T.sentence_case("region_type").alias("type"),
        T.percent(F.col("confidence"), 1).alias("confidence"), "tokens", *text,
    )


def token_report(regions: DataFrame) -> DataFrame:
    """One row per word, numbered within its region."""
    return regions.select(
        "doc_id", "region_id", "engine", "region_type", F.posexplode("words").alias("pos", "w")
    ).select(
        "doc_id", "region_id", T.page_number("region_id").alias("page_no"), T.sentence_case("region_type").alias("type"),
        (F.col("pos") + 1).alias("token_no"), F.col("w.text").alias("word"), T.percent(F.col("w.confidence"), 1).alias("confidence"),
        "engine", *[F.round(F.col(f"w.{c}"), 1).alias(f"bbox_{c}") for c in ("x", "y", "width", "height")],
    )


def metrics_summary(metrics: DataFrame, mode: str = "full") -> DataFrame:
    """(doc_id, line, field, value) summary sheet."""
    rows = [
        ("OCR Mode", F.lit(mode)), ("Primary Engine", F.col("engine_used")),
        ("Pages Processed", F.col("page_count").cast("string")), ("Regions Detected", F.col("regions").cast("string")),
        ("Characters Extracted", F.col("characters_extracted").cast("string")),
        ("Avg Confidence", T.percent(F.col("avg_confidence"), 1)),
        ("Fallback Triggered", F.when(F.col("fallback_triggered"), "Yes").otherwise("No")),
        ("Total Tokens", F.col("tokens").cast("string")),
    ]
    return metrics.select("doc_id", F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("line"), F.lit(f).alias("field"), v.alias("value")) for i, (f, v) in enumerate(rows)
    ])))


def choose_text_source(digital: DataFrame, ocr: DataFrame, least: int = fv.MIN_DIGITAL_TEXT) -> DataFrame:
    """Digital text when it has at least 80 characters, else the OCR text: (doc_id, text, text_source)."""
    enough = F.length(T.strip("digital_text")) >= least
    joined = digital.join(ocr, "doc_id", "full")
    return joined.select(
        "doc_id", F.when(enough, T.strip("digital_text")).otherwise(T.or_blank("ocr_text")).alias("text"),
        F.when(enough, "digital").otherwise("ocr").alias("text_source"),
    )
