"""Quality rules by cross-document line frequency.

Lines are normalised and hashed, distinct texts of a host that hold a line are counted, lines held by more than a
limit are removed, and a document that loses too much of its words is rejected. On top come the base rules on words.

What is no boilerplate must not be lost: the limit grows with the distinct texts of a host, and texts that share their
body count once for its lines, so a large group of near copies keeps its text and is left to near-duplicate removal. A
text shares its body when lines above the limit hold so much of it that it would be rejected; its body is told by the
rarest of these lines, the first of equally rare ones. Near copies with up to e edited lines have at most e + 1 such
lines between them. A line that more texts than the limit hold otherwise goes as before, so pages that are mostly such
lines are still rejected. judge() gives the verdicts, clean() the texts that pass; both follow the same rule.

All of it is DataFrame functions: texts stay where they are read, only (host, line hash, text hash) rows are shuffled.

Defined results: a null text has no words, so it fails the base rules; null hosts form one host; exact copies of a
text count once for their host; repeated rows are judged alike; an empty table gives an empty result; columns of
the input named like ours are replaced by ours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrawl.llm.common import bind, compute_once, join_on, lines, normal_line, pack, text_key, whole, words
from papertrawl.session import cut_lineage

#: A line in more distinct texts of one host than this may be boilerplate.
MAX_DOCUMENTS = 50
#: The limit is this percentage of the distinct texts of a host, if that is more.
MAX_HOST_PERCENT = 1
#: A document must keep at least this percentage of its words.
MIN_KEPT_PERCENT = 50
#: Base rules: least number of words, largest percentage of words in repeated windows, words of a window.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
_KEY = ["doc_id", "host", "text_hash"]


def repeat_words(ws: Column, window: int = WINDOW) -> Column:
    """Words inside windows of so many words that occur twice or more in the list."""
    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        def positions(p: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(p, a)["h"] == F.get(p, b)["h"], F.lit(False))
            return F.array_sort(F.transform(
                F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda k: same(k, k - 1) | same(k, k + 1)),
                lambda k: F.get(p, k)["i"]))
        # each repeated window covers up to the next one, the last one its full length
        gaps = lambda at: F.aggregate(
            F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))),
                       lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window))),
            F.lit(0).cast("bigint"), lambda s, g: s + g)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(
            bind(bind(pairs, positions), gaps))

    hashes = bind(F.transform(ws, lambda w: F.xxhash64(w)), lambda hs: F.transform(
        F.sequence(F.lit(1), F.size(hs) - (window - 1)), lambda i: F.xxhash64(F.slice(hs, i, window))))
    return F.when(F.size(ws) < window, F.lit(0).cast("bigint")).otherwise(bind(hashes, covered))


def measures(text: Column) -> Column:
    """Counts of one text as a struct: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    filled = F.filter(lines(text), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def of(ws: Column) -> Column:
        counts = F.struct(
            F.size(ws).cast("bigint").alias("n_words"),
            F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
            (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
            bind(filled, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            repeat_words(ws).alias("n_repeat_words"))
        return bind(counts, lambda c: c.withField("base_failed", (c["n_words"] < MIN_WORDS) | (
            100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])))

    return bind(words(text), of)


def line_rows(docs: DataFrame, host: Column) -> DataFrame:
    """One row per line that has words: keys of its document, position, hash of the normalised line, its words."""
    keyed = docs.select("doc_id", host.alias("host"), text_key().alias("text_hash"),
                        F.posexplode(lines(whole(F.col("text")))).alias("pos", "line"))
    normal = keyed.select(*_KEY, "pos", normal_line(F.col("line")).alias("normal")).filter("normal != ''")
    return normal.select(*_KEY, "pos", F.xxhash64("normal").alias("line_hash"),
                         F.size(F.split("normal", " ", -1)).alias("line_words"))


def frequent_lines(line_table: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """Lines of a host in more distinct texts than the limit. Both counting steps combine before they shuffle."""
    return (line_table.groupBy("host", "line_hash").agg(F.countDistinct("text_hash").alias("n_documents"))
            .filter(F.col("n_documents") > max_documents))


def boilerplate(docs: DataFrame, host: Column, max_documents: int = MAX_DOCUMENTS,
                host_percent: float = MAX_HOST_PERCENT) -> DataFrame:
    """Per document with boilerplate lines: how many words they hold and their hashes (bounded by its own lines)."""
    texts = docs.select("doc_id", host.alias("host"), text_key().alias("text_hash"),
                        F.size(words(whole(F.col("text")))).alias("text_words"))
    rows = cut_lineage(line_rows(docs, host), "lines")
    limits = texts.groupBy("host").agg(F.greatest(F.lit(max_documents), F.floor(
        F.countDistinct("text_hash") * F.lit(host_percent) / 100)).alias("most"))
    frequent = join_on(frequent_lines(rows, max_documents), limits, ["host"]).filter("n_documents > most")
    # a set: repeated rows are judged as one; bounded by the lines of one document
    held = join_on(rows, frequent, ["host", "line_hash"]).groupBy(*_KEY, "most").agg(
        F.collect_set(F.struct("n_documents", "pos", "line_hash", "line_words")).alias("held"))
    held = join_on(held, texts.dropDuplicates(_KEY), _KEY)
    left = 100 * (F.col("text_words") - F.aggregate("held", F.lit(0), lambda n, x: n + x["line_words"]))
    body = F.when(left < MIN_KEPT_PERCENT * F.col("text_words"), F.xxhash64(F.lit("body"), F.array_min("held")["line_hash"])
                  ).otherwise(F.col("text_hash"))
    held = cut_lineage(held.select(*_KEY, "most", "held", body.alias("body")), "held-lines")  # read twice
    each = held.select(*_KEY, "most", "body", F.explode("held").alias("x")).select(
        *_KEY, "most", "body", "x.line_hash", "x.line_words")
    often = each.groupBy("host", "line_hash").agg(F.countDistinct("body").alias("bodies"), F.max("most").alias("most"))
    often = often.filter("bodies > most").select("host", "line_hash")
    return join_on(each, often, ["host", "line_hash"]).groupBy(*_KEY).agg(
        F.sum("line_words").alias("removed_words"), F.collect_set("line_hash").alias("removed"))


def _kept(m: Column, removed_words: Column) -> Column:
    left = 100 * (m["n_words"] - F.coalesce(removed_words, F.lit(0)))
    return ~m["base_failed"] & (left >= MIN_KEPT_PERCENT * m["n_words"])


def judge(docs: DataFrame, host: str = "source", max_documents: int = MAX_DOCUMENTS,
          host_percent: float = MAX_HOST_PERCENT) -> DataFrame:
    """One row per document, without its text: doc_id, the counts, removed_words, base_failed, kept."""
    own = docs.select("doc_id", docs[host].alias("host"), text_key().alias("text_hash"),
                      measures(whole(docs["text"])).alias("m"))
    found = boilerplate(docs, docs[host], max_documents, host_percent).drop("removed")
    return join_on(own, found, _KEY, "left").select(
        "doc_id", "m.*", F.coalesce("removed_words", F.lit(0)).alias("removed_words"),
        _kept(F.col("m"), F.col("removed_words")).alias("kept"))


def clean(docs: DataFrame, host: str = "source", max_documents: int = MAX_DOCUMENTS,
          host_percent: float = MAX_HOST_PERCENT) -> DataFrame:
    """The documents that pass, without their boilerplate lines; n_chars follows where there is one."""
    own = pack(docs, doc_id=docs["doc_id"], host=docs[host], text_hash=F.xxhash64(docs["text"]))
    own = compute_once(own, {"m": measures(whole(F.col("row.text")))})
    own = own.filter(~F.col("m.base_failed")).withColumn("n_words", F.col("m.n_words")).drop("m")
    found = boilerplate(docs, docs[host], max_documents, host_percent)
    left = 100 * (F.col("n_words") - F.coalesce("removed_words", F.lit(0)))
    both = join_on(own, found, _KEY, "left").filter(left >= MIN_KEPT_PERCENT * F.col("n_words"))
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(F.filter(
        lines(F.col("row.text")), lambda x: ~F.array_contains("removed", F.xxhash64(normal_line(x)))), "\n"))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = bind(row, lambda r: r.withField("n_chars", F.when(
            F.col("removed").isNull(), r["n_chars"]).otherwise(F.char_length(r["text"]).cast("bigint"))))
    return both.select(row.alias("row")).select("row.*")
