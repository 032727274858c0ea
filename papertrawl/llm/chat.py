"""Chat formatting with typed content parts.

The content of a turn is a list of parts: text, image, audio or document. A visitor with one case per kind turns
each part into its place in the formatted conversation: text is escaped, everything else becomes an ordered
placeholder, and its reference and expanded token count are recorded as an attachment. The loss mask records where
assistant text lies. All of it is DataFrame functions.

Layout: <turn ROLE>CONTENT</turn> and a line feed per turn, <image N>, <audio N>, <document N> for attachments. No
control string can arise from a text or role, since both are escaped: \\ as \\b, < as \\l, > as \\g. Hence the
characters < and > only occur in control strings, and reading back is a plain split and the inverse replacements.

Defined results: null text is empty text, a null role an empty role; parts of unknown kind are kept as attachments
of no tokens; turns are ordered by (turn, role, content), null turns first, so ties and repeated rows have one order
and all stay; rows without conv_id form one conversation; an empty table gives an empty result; other columns are
not read. A conversation is one formatted string, so it must fit in a row, however many turns it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papertrawl.llm.common import bind, compute_once, whole

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Expanded tokens: an image is cut into square patches, audio into frames, a document into pages.
PATCH, FRAMES_PER_SECOND, TOKENS_PER_PAGE = 28, 25, 1024
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
LEARNED_ROLES = ("assistant",)


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    """A content list of one text part."""
    nothing = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("kind"), whole(text).alias("text"),
                            *[F.lit(None).cast(kind).alias(name) for name, kind in nothing.items()]))


# The visitor: what each kind of part expands to. A new kind is one more entry.
EXPANDED = {
    "image": lambda p: F.ceil(p["width"] / PATCH) * F.ceil(p["height"] / PATCH),
    "audio": lambda p: F.ceil(p["seconds"] * FRAMES_PER_SECOND),
    "document": lambda p: p["pages"] * TOKENS_PER_PAGE,
}


def expanded_tokens(part: Column) -> Column:
    found = F.lit(None).cast("bigint")
    for kind, count in EXPANDED.items():
        found = F.when(part["kind"] == kind, count(part).cast("bigint")).otherwise(found)
    return F.coalesce(found, F.lit(0).cast("bigint"))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"] == "text", F.lit(False))


def _visit(before: Column) -> Column:
    """The parts of one turn as stretches of output, in order. before: attachments of earlier turns."""
    learned = F.coalesce(F.col("role").isin(*LEARNED_ROLES), F.lit(False))

    def one(p: Column, k: Column) -> Column:
        number = before + F.size(F.filter(F.slice("content", 1, k + 1), lambda q: ~_is_text(q)))
        mark = F.concat(F.lit("<"), escape(whole(p["kind"])), F.lit(" "), number.cast("string"), F.lit(">"))
        return F.struct(F.when(_is_text(p), escape(whole(p["text"]))).otherwise(mark).alias("s"),
                        (_is_text(p) & learned).alias("loss"))

    return F.transform("content", one)


def _length(strings: Column, of) -> Column:
    return F.aggregate(strings, F.lit(0).cast("bigint"), lambda n, p: n + of(p["s"]).cast("bigint"))


def format_chats(turns: DataFrame, content: str = "content") -> DataFrame:
    """conv_id, n_turns, text, loss_spans, attachments of every conversation.

    turns: conv_id, turn, role and a column of content parts (PART). loss_spans: first byte and bytes in UTF-8,
    first code point and code points, of each stretch that is learned. attachments: number, kind, ref, tokens.
    Numbers and places are running sums over the turns, so a long conversation costs what its turns cost.
    """
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    earlier = lambda n: F.coalesce(
        F.sum(n).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    rows = turns.select("conv_id", "turn", "role", turns[content].alias("content"))
    rows = rows.withColumn("others", F.filter("content", lambda p: ~_is_text(p)))
    rows = rows.withColumn("pos", F.row_number().over(ordered)).withColumn("before", earlier(F.size("others")))
    head = F.concat(F.lit("<turn "), escape(whole(F.col("role"))), F.lit(">"))
    rows = compute_once(rows, {"head": head, "parts": _visit(F.col("before"))})
    rows = compute_once(rows, {"shown": F.concat("head", F.array_join(F.transform("parts", lambda p: p["s"]), ""),
                                                 F.lit("</turn>\n"))})
    rows = rows.withColumn("bytes", earlier(F.octet_length("shown"))).withColumn("chars", earlier(F.char_length("shown")))
    spans = F.filter(F.transform("parts", lambda p, k: F.when(p["loss"], bind(F.slice("parts", 1, k), lambda some: F.struct(
        (F.col("bytes") + F.octet_length("head") + _length(some, F.octet_length)).alias("byte_start"),
        F.octet_length(p["s"]).cast("bigint").alias("bytes"),
        (F.col("chars") + F.char_length("head") + _length(some, F.char_length)).alias("start"),
        F.char_length(p["s"]).cast("bigint").alias("chars"))))), F.isnotnull)
    found = F.transform("others", lambda p, k: F.struct(
        (F.col("before") + k + 1).alias("number"), p["kind"].alias("kind"), p["ref"].alias("ref"),
        expanded_tokens(p).alias("tokens")))
    return rows.select("conv_id", F.struct("pos", "shown", spans.alias("spans"), found.alias("found")).alias("t")).groupBy(
        "conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.size("t").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("t", lambda t: t["shown"]), "").alias("text"),
        F.flatten(F.transform("t", lambda t: t["spans"])).alias("loss_spans"),
        F.flatten(F.transform("t", lambda t: t["found"])).alias("attachments"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, text, turns (role and text) and loss_text (the unescaped learned stretches), from the output alone."""
    whole_turns = F.slice(F.split("text", "</turn>\n", -1), 1, F.size(F.split("text", "</turn>\n", -1)) - 1)
    turn = lambda t: F.struct(
        unescape(F.substring_index(F.substring(t, 7, 1 << 30), ">", 1)).alias("role"),
        unescape(F.regexp_replace(t, "^<turn [^>]*>", "")).alias("text"))
    raw = F.col("text").cast("binary")
    learned = bind(raw, lambda r: F.array_join(F.transform("loss_spans", lambda s: unescape(
        F.substring(r, (s["byte_start"] + 1).cast("int"), s["bytes"].cast("int")).cast("string"))), ""))
    return formatted.select("conv_id", "text", F.transform(whole_turns, turn).alias("turns"), learned.alias("loss_text"))
