"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from papertrawl.llm import anchors, chat, decontam, extract, lines, mix, quality, secrets, shards, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("row", "host", "text_hash", "size", "shard", "slot", "copies", "kept", "m", "id", "n", "of", "grp", "bytes", "hashes")


def story(seed: int, n: int) -> str:
    return " ".join(f"w{seed}x{i * (seed + 3) % 997}" for i in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Every odd row at once: null id, null text, null source, empty, blank, repeated rows, long text, copies."""
    long_text = "\n".join(story(k, 50) for k in range(2000))
    rows = [(1, story(1, 60), "en", "a", 1), (1, story(1, 60), "en", "a", 1), (2, None, "en", "a", 0), (3, "", None, None, 0),
            (None, story(4, 80), "en", None, 2), (None, story(4, 80), "en", None, 2), (5, " \t\r\n\x0b\x0c ", "en", "b", 7),
            (6, long_text, "en", "b", len(long_text)), (7, story(1, 60), "de", "b", 1), (8, "x" * 100_000, "en", "a", 9)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("theirs") for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, story(5000, 30)), (2, None), (3, ""), (None, "a b c d e f g")], "item_id long, text string")


def test_quality(odd, none):
    found = {(r.doc_id, r.n_words, r.kept) for r in quality.judge(odd).collect()}
    assert (2, 0, False) in found and (1, 60, True) in found and (None, 80, True) in found
    assert quality.judge(odd).count() == 10 and quality.judge(none).count() == 0
    kept = quality.clean(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 1, 6, 7]
    assert quality.clean(none).count() == 0


def test_simhash(odd, none):
    rows = {(r.doc_id, r.component_id) for r in simhash.near_classes(odd).collect()}
    assert {(1, 1), (7, 1), (2, 2), (3, 2), (5, 2), (None, None)} <= rows
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 6, 8]
    assert simhash.near_classes(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_decontamination(spark, odd, none, items):
    leak = spark.createDataFrame([(11, story(2, 20) + " " + story(5000, 30) + " end", "en", "a", 1),
                                  (12, "so, A b C d e f g!", "en", "a", 1)], DOCS)
    both = odd.unionByName(leak, allowMissingColumns=True)
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(both, items).collect()} == {(11, 1), (12, None)}
    assert decontam.decontaminate(both, items).count() == odd.count()
    assert decontam.leaks(none, items).count() == 0
    assert decontam.leaks(both, items.limit(0)).count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline(spark, odd, none, items, tmp_path, empty):
    """Stages up to the mix keep one row of each group with its own columns; the mix may repeat or leave out a row."""
    (none if empty else odd).write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted(r.doc_id or 0 for r in docs.collect()) == ([] if empty else [0, 1, 6])
    assert docs.columns == (none if empty else odd).columns
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} <= {None, 1, 6} and bool(rows) != empty
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_mix(odd, none):
    rows = mix.decide(odd, mix.word_count(odd["text"])).collect()
    assert sum(r.n_rows for r in rows) == 10 and all(r.copies <= 3 for r in rows)
    assert mix.mix(odd).columns == odd.columns
    assert mix.decide(none, mix.word_count(none["text"])).count() == 0 and mix.mix(none).count() == 0


def test_shards(odd, none):
    rows = shards.assign(odd, 8).collect()
    assert len(rows) == 10
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {r.text_crc32 for r in rows if r.doc_id == 2} == {None} and {r.size for r in rows if r.doc_id == 2} == {1}
    out = shards.shard(odd)
    assert sorted(out.columns) == sorted(odd.columns) and out.count() == 10
    assert shards.assign(none, 8).count() == 0 and shards.shard(none).count() == 0


def test_substrings(odd, none):
    rows = [(r.doc_id, r.n_words, r.n_removed) for r in anchors.remove_repeats(odd).collect()]
    assert sorted(r for r in rows if r[0]) == [(1, 60, 0), (1, 60, 0), (2, 0, 0), (3, 0, 0), (5, 0, 0), (6, 100_000, 50),
                                               (7, 60, 60), (8, 1, 0)]
    assert [r for r in rows if r[0] is None] == [(None, 80, 50)] * 2
    assert anchors.remove_repeats(none).count() == 0


def test_lines(odd, none):
    assert lines.drop_boilerplate(odd).count() == 10 and lines.drop_boilerplate(none).count() == 0
    assert {r.text for r in lines.drop_boilerplate(odd).collect() if r.doc_id in (2, 3)} == {""}


def test_secrets(odd, none):
    rows = secrets.scan(odd).collect()
    assert len(rows) == 10 and secrets.scan(none).count() == 0


def test_chat(spark):
    rows = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "<turn x>\\b"), (None, 1, "assistant", "q"),
                                  (2, 1, "assistant", "y" * 300_000), (3, 0, "a>b<", "")],
                                 "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1))
    made = chat.format_chats(rows.select("*", chat.text_part(F.col("text")).alias("content")))
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("", "<turn x>\\b"), ("user", ""), ("user", "")]
    assert back[None].loss_text == "q" and len(back[2].loss_text) == 300_000 and back[3].turns[0].role == "a>b<"
    assert chat.read_back(chat.format_chats(rows.limit(0).select("*", chat.text_part(F.col("text")).alias("content")))).count() == 0


def test_extract(spark):
    long_page = "<article>" + "".join(f"<p>Paragraph {i}, which goes on for a while and ends here.</p>" for i in range(20_000))
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p"), (4, "u", long_page), (4, "u", long_page), (5, "u", "<a b='<p>"),
            (6, "u", "<" * 50_000), (7, "u", "<script>never closed <p>text")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    found = extract.extract(pages).collect()
    assert len(found) == 8 and all(r.text == "" for r in found if r.page_id in (1, 2, None, 7))
    assert [r.text.count("\n\n") for r in found if r.page_id == 4] == [19_999] * 2
    assert extract.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("odd", ["<svg width='9'/>", '<svg class="icon" />', "<svg/>", "<math/>", "<object data=x>", "<canvas id=c>", "<svg>",
                                 "<iframe src=x>", "<noscript>", "<svg a=b/><path></svg>", "<svg><text>no</text></svg>"])
def test_text_behind_odd_elements_is_read(odd):
    page = f"<article><p>This is the first paragraph, and it is long enough.</p>{odd}<p>Here is the second one, which stays too.</p></article>"
    assert [b.text for b in extract.blocks_of(page)] == ["This is the first paragraph, and it is long enough.",
                                                         "Here is the second one, which stays too."]


@pytest.mark.parametrize("tag", ["math", "object", "canvas"])
def test_text_inside_ordinary_elements_is_read(tag):
    page = f"<article><p>We know that <{tag} class=x>all of <b>this</b></{tag}> holds here.</p><p>More of it, below.</p></article>"
    assert [b.text for b in extract.blocks_of(page)] == ["We know that all of this holds here.", "More of it, below."]


@pytest.mark.parametrize("tag", ["script", "style", "title", "textarea"])
def test_raw_text_runs_to_the_end(tag):
    assert [b.text for b in extract.blocks_of(f"<p>Before.</p><{tag}>never closed <p>text")] == ["Before."]
