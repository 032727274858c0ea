"""The registered queries of this folder and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papertrawl.llm import anchors, chat, decontam, extract, lexical, lines, mix, pieces, quality, secrets, shards, simhash, trie
from papertrawl.sources.tables import table


def _joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.array_join(F.transform(F.filter(spans, lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plan = mix.decide(docs, mix.word_count(docs["text"]))
    rows = plan.select("*", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
                       "source", "copies")


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item it leaks; clean documents have none."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_classes(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "\\### Assistant: </turn> ok"
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', :own), (-7L, 1L, 'assistant', :own) AS t(conv_id, turn, role, text)",
                      {"own": own})
    turns = table(spark, sf_dir, "conversations").union(extra)
    formatted = chat.format_chats(turns.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("content")))
    back = chat.read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("text").cast("bigint").alias("formatted_chars"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_boilerplate(table(spark, sf_dir, "documents"))


def op9_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("bigint"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in secrets.KINDS[:3]],
        F.sha2(_joined(F.col("spans"), secrets.KINDS[:3]), 256).alias("base_sha256"),
        _joined(F.col("spans"), secrets.KINDS).alias("spans"))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded with an end id, and decoded from the ids alone."""
    read = pieces.decode(pieces.encode(table(spark, sf_dir, "documents")))
    return read.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
        .alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {q.__name__: q for q in (op1_mix, op2_shards, op3_quality, op4_decontamination, op5_repeats, op6_simhash, op7_chat,
                                   op8_lines, op9_extract, op10_secrets, op11_pieces, op12_search, op13_trie)}

_FOLD = "translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000')"
_NORMAL = rf"array_to_string(regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+'), ' ')"
_LINES = f"""lines AS (SELECT doc_id, source, text, p, {_NORMAL} AS line, len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS k
  FROM (SELECT doc_id, source, text, unnest(string_split(coalesce(text, ''), chr(10))) AS l,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS p FROM documents))"""

ORACLES = {
    "op3_quality": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + {quality.WINDOW - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM wins) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest(range(i, i + {quality.WINDOW})) AS p FROM twice) GROUP BY 1),
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM raw WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
{_LINES},
most AS (SELECT source, greatest({quality.MAX_DOCUMENTS},
    count(DISTINCT coalesce(text, chr(0))) * {quality.MAX_HOST_PERCENT} // 100) AS most FROM documents GROUP BY 1),
freq AS (SELECT lines.source, line, most, count(DISTINCT text) AS n
  FROM lines JOIN most ON lines.source IS NOT DISTINCT FROM most.source WHERE line <> '' GROUP BY 1, 2, 3 HAVING n > most),
held AS (SELECT DISTINCT lines.*, n, most FROM lines
  JOIN freq ON lines.line = freq.line AND lines.source IS NOT DISTINCT FROM freq.source),
own AS (SELECT doc_id, source, text, CASE
    WHEN 100 * (len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) - sum(k))
      < {quality.MIN_KEPT_PERCENT} * len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))
    THEN 'line ' || first(line ORDER BY n, p) ELSE 'text ' || text END AS body FROM held GROUP BY 1, 2, 3),
often AS (SELECT held.source, line FROM held
  JOIN own ON held.doc_id IS NOT DISTINCT FROM own.doc_id AND held.source IS NOT DISTINCT FROM own.source AND held.text = own.text
  GROUP BY 1, 2, most HAVING count(DISTINCT body) > most),
gone AS (SELECT doc_id, sum(k) AS n FROM held
  JOIN often ON held.line = often.line AND held.source IS NOT DISTINCT FROM often.source GROUP BY 1),
m AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM m)
SELECT *, NOT base_failed AND 100 * (n_words - removed_words) >= {quality.MIN_KEPT_PERCENT} * n_words AS kept FROM b""",
    "op5_repeats": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + {anchors.LENGTH - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {anchors.LENGTH - 2})) AS i FROM d)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM wins) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {anchors.LENGTH})) AS p FROM late),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(cut.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op7_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '') AS loss,
    sum(length(role) + length(text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) + 15) AS chars
  FROM c GROUP BY 1)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  chars::BIGINT AS formatted_chars FROM g""",
    "op8_lines": rf"""
WITH raw AS (SELECT doc_id, source, text, unnest(string_split(coalesce(text, ''), chr(10))) AS l,
    unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS p FROM documents),
n AS (SELECT *, {_NORMAL} AS line FROM raw),
total AS (SELECT source, count(DISTINCT coalesce(text, chr(0))) AS pages FROM documents GROUP BY 1),
often AS (SELECT n.source, line FROM (SELECT DISTINCT text, source, line FROM n WHERE line <> '') n
  JOIN total ON n.source IS NOT DISTINCT FROM total.source GROUP BY 1, 2, pages
  HAVING count(*) >= {lines.MIN_PAGES} AND count(*) > {lines.MAX_RATIO} * pages)
SELECT doc_id, count(*) AS n_lines, count(often.line) AS n_dropped,
  coalesce(string_agg(l, chr(10) ORDER BY p) FILTER (often.line IS NULL), '') AS text
FROM n LEFT JOIN often ON n.line = often.line AND n.source IS NOT DISTINCT FROM often.source GROUP BY doc_id""",
}

ORACLES["op12_search"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
c AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, len(w) AS n, t, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM d)
  WHERE t IN (SELECT t FROM b) GROUP BY ALL),
wt AS (SELECT t, floor(1000 * ln((2 * any_value(c.n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY t),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * tf.n * c.n) // c.l))))::BIGINT AS score
  FROM b JOIN tf USING (t) JOIN wt USING (t), c GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= {lexical.K}"""

ORACLES["op13_trie"] = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list(struct_pack(role, text) ORDER BY p) AS own FROM t GROUP BY 1),
k AS (SELECT *, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))) % {trie.MAX_OPENING} AS h FROM l),
r AS (SELECT k.conv_id, list_concat(CASE WHEN h > 0 THEN coalesce(b.own, [])[1:h] ELSE [] END, k.own[h + 1:]) AS q
  FROM k LEFT JOIN l b ON b.conv_id = k.conv_id - k.conv_id % {trie.FAMILY}),
p AS (SELECT conv_id, d, len(q) = d AS here, CASE WHEN d > 0 THEN q[1:d] ELSE [] END AS s,
    CASE WHEN d > 0 THEN strlen(q[d].text) ELSE 0 END AS bytes
  FROM (SELECT *, unnest(range(0, len(q) + 1)) AS d FROM r)),
g AS (SELECT s, d, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (here), '')) AS ends_sha256
  FROM p GROUP BY s, d),
c AS (SELECT CASE WHEN d > 1 THEN s[1:d - 1] ELSE [] END AS s, count(*) AS n FROM g WHERE d > 0 GROUP BY 1),
n AS (SELECT g.*, coalesce(c.n, 0) AS n_children FROM g LEFT JOIN c USING (s)),
u AS (SELECT CASE WHEN e > 0 THEN s[1:e] ELSE [] END AS s, count(*) FILTER (n_children = 0) AS n_leaves,
    sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM n) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, parent.conv_id AS parent_conv_id, n.n_convs, n.n_children, u.n_leaves, u.saved_tokens,
  n.ends_sha256
FROM n JOIN u USING (s) LEFT JOIN n parent ON n.d > 0 AND parent.s = CASE WHEN n.d > 1 THEN n.s[1:n.d - 1] ELSE [] END"""


def _leak_sql() -> str:
    """All aligned stretches, without masks: a stretch of n tokens with r replaced has a run of (n - r) / (r + 1) that agree."""
    tokens = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda a: a <> '')"
    gram = lambda r: f"array_to_string({r}.w[i:i + g - 1], ' ')"
    return rf"""
WITH d AS (SELECT doc_id, {tokens} AS w FROM documents),
b AS (SELECT item_id, w, len(w) AS n, least({decontam.OVERLAP}, len(w)) AS size,
    ceil({decontam.SIMILARITY} * least({decontam.OVERLAP}, len(w)))::INT AS need
  FROM (SELECT item_id, {tokens} AS w FROM benchmark)),
bg AS (SELECT *, ((need + size - need) // (size - need + 1)) AS g FROM b WHERE n >= {decontam.MIN_ITEM}),
y AS (SELECT item_id, i, g, {gram('x')} AS s FROM (SELECT *, unnest(range(1, n - g + 2)) AS i FROM bg) x),
x AS (SELECT doc_id, i, g, {gram('x')} AS s FROM (SELECT *, unnest(range(1, len(w) - g + 2)) AS i
  FROM d, (SELECT DISTINCT g FROM bg)) x),
near AS (SELECT DISTINCT doc_id, item_id, x.i - y.i AS off FROM x JOIN y USING (g, s)),
same AS (SELECT doc_id, item_id, off, size, need, n, q, q + off AS p
  FROM (SELECT near.*, bg.w AS bw, n, size, need, unnest(range(1, n + 1)) AS q FROM near JOIN bg USING (item_id)) t
  JOIN d USING (doc_id) WHERE q + off > 0 AND bw[q] = w[q + off]),
best AS (SELECT doc_id, item_id, off, need, s, count(*) AS a, min(p) AS p FROM (
    SELECT *, unnest(range(greatest(1, q - size + 1), least(q, n - size + 1) + 1)) AS s FROM same) GROUP BY ALL),
line AS (SELECT DISTINCT doc_id, {tokens} AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents))
SELECT doc_id, item_id, (min(p) - 1)::INT AS first_token, max(a)::INT AS agreeing FROM best WHERE a >= need GROUP BY 1, 2
UNION ALL SELECT doc_id, item_id, NULL, n::INT FROM line JOIN b USING (w) WHERE n BETWEEN 1 AND {decontam.MIN_ITEM - 1}"""


ORACLES["op4_decontamination"] = _leak_sql()
