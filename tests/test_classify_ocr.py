"""Classification and OCR choices."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from papertrawl import fixed_values as fv
from papertrawl.operators import classify as C
from papertrawl.operators import models as M
from papertrawl.operators import ocr as O

#: A page of each class that names every second of the class's own keywords.
TEXTS = {c: "This page speaks of " + "; then of ".join(fv.CLASS_KEYWORDS[c][::2]) + "."
         for c in ("invoice", "bank_statement", "payslip", "contract")}


@pytest.fixture(scope="module")
def model(spark):
    return C.train(C.training_texts(spark))


def test_classes_and_probabilities(spark, model):
    rows = [(i, t) for i, t in enumerate([*TEXTS.values(), "", "invoice " * 2000, "unrelated words only"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    scores = C.score(docs, model)
    per_doc = {}
    for r in scores.collect():
        assert 0 <= r["confidence"] <= 1
        per_doc.setdefault(r["doc_id"], []).append(r["confidence"])
    assert all(len(v) == 5 and abs(sum(v) - 1) < 1e-9 for v in per_doc.values()) and len(per_doc) == len(rows)
    votes = {r["doc_id"]: r["top_prediction"] for r in C.classify_corpus(docs, model).collect()}
    assert [votes[i] for i in range(4)] == list(TEXTS)
    assert votes[5] == "invoice" and votes[4] is not None


def test_sums_not_averages_decide(spark):
    rows = [(1, "a", "invoice", 0.5), (1, "a", "receipt", 0.45), (1, "b", "invoice", 0.2), (1, "b", "receipt", 0.3)]
    got = C.ensemble_vote(spark.createDataFrame(rows, "doc_id int, model string, document_type string, confidence double")).first()
    assert (got["top_prediction"], got["is_multi_label"], got["classification_confidence"]) == ("receipt", True, 0.45)


def test_routes(spark):
    df = spark.createDataFrame([("IFSC x", "receipt"), ("plain", "contract"), ("plain", "bank_statement"), ("upi", None), ("NEFT", None)],
                               "text string, label string")
    got = [r[0] for r in df.select(C.keyword_route("text", F.col("label"))).collect()]
    assert got == ["bank_statement", "invoice", "bank_statement", "invoice", "bank_statement"]


def words(region, kind, engine, *confidences):
    return [(1, 0, region, kind, engine, i, f"{engine[0]}{i}", float(c), 0.0, 0.0, 0.1, 0.1) for i, c in enumerate(confidences)]


def test_engine_choice(spark):
    rows = [
        *words(0, "text", "paddle", .9, .9), *words(0, "text", "easyocr", .9, .9), *words(0, "text", "tesseract", .99),
        *words(1, "text", "paddle", .5), *words(1, "text", "easyocr", .6), *words(1, "text", "tesseract", .7),
        *words(2, "table", "paddle", .2), *words(2, "table", "easyocr", .9), *words(2, "table", "tesseract", .9),
        *words(3, "text", "easyocr", .8), *words(4, "table", "easyocr", .9),
    ]
    df = spark.createDataFrame(rows, "doc_id int, page int, region int, region_type string, engine string, word_idx int, "
                                     "text string, confidence double, x double, y double, width double, height double")
    regions = O.region_rollup(O.select_engine(O.engine_regions(df)))
    got = {r["region"]: (r["engine"], r["text"], r["fallback"]) for r in regions.collect()}
    assert got == {0: ("paddle", "p0 p1", False), 1: ("tesseract", "t0", False), 2: ("paddle", "p0", True), 3: ("easyocr", "e0", False)}
    metrics = O.document_metrics(regions).first()
    assert (metrics["engine_used"], metrics["regions"], metrics["tokens"], metrics["fallback_triggered"]) == ("paddle", 4, 5, True)
    assert O.page_full_text(regions).first()["page_text"] == "p0 p1 t0 p0 e0"
    assert [r["word"] for r in O.token_report(regions).filter("region_id = 'page0-region-0'").orderBy("token_no").collect()] == ["p0", "p1"]


def test_an_engine_nobody_listed_can_win(spark):
    rows = [
        *words(0, "text", "paddle", .5), *words(0, "text", "newcomer", .6), *words(0, "text", "tesseract", .6),
        *words(1, "text", "paddle", .5), *words(1, "text", "newcomer", .9), *words(1, "text", "tesseract", .6),
        *words(2, "text", "newcomer", .4), *words(3, "table", "newcomer", .9), *words(3, "table", "paddle", .1),
        *words(4, "text", "alpha", .7), *words(4, "text", "zeta", .7),
    ]
    df = spark.createDataFrame(rows, "doc_id int, page int, region int, region_type string, engine string, word_idx int, "
                                     "text string, confidence double, x double, y double, width double, height double")
    by_region = O.engine_regions(df)
    got = {r["region"]: r["engine"] for r in O.select_engine(by_region).collect()}
    assert got == {0: "tesseract", 1: "newcomer", 2: "newcomer", 3: "paddle", 4: "alpha"}
    got = {r["region"]: r["engine"] for r in O.select_engine(by_region, order=["newcomer", "paddle", "zeta"]).collect()}
    assert got == {0: "newcomer", 1: "newcomer", 2: "newcomer", 3: "newcomer", 4: "zeta"}


def test_a_model_is_loaded_once_a_worker_and_reads_whole_texts(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return [[0.0] * 26, [1.0] + [0.0] * 25, [0.0] * 25 + [1.0], [0.0] * 26, [0.0] * 26]

    rows = [(i, "b" * 600 + "a" * 600 if i % 2 else "b" * 600 + "z" * 600) for i in range(2000)] + [(5000, None), (5001, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(16)
    scorer = M.as_scorer(M.letter_classifier(load=load), batch=10)
    scores = C.score_with_model(docs, scorer).collect()
    workers = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(workers) == len(set(workers)) and len(scores) == 5 * len(rows)
    best = {}
    for r in scores:
        if r.doc_id < 5000 and r.confidence > 0.5:
            best[r.doc_id] = r.document_type
    assert best == {i: fv.CLASSES[1] if i % 2 else fv.CLASSES[2] for i in range(2000)}  # what tells them apart is behind character 512
    assert {round(r.confidence, 6) for r in scores if r.doc_id >= 5000} == {0.2}
    cut = C.score_with_model(docs, scorer, chars=512)
    assert {round(r.confidence, 6) for r in cut.collect()} == {0.2}


def test_statistics_cover_every_term(spark):
    texts = [" ".join(f"w{k}x{i}" for i in range(300)) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    idf = C.idf_table(docs)
    assert idf.count() == 40 * (300 + 299) and C.idf_table(docs, most=50).count() == 50
    per_doc = C.tfidf_features(docs, idf).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert all(r["n"] == 599 and abs(r["s"] - 1) < 1e-9 for r in per_doc) and len(per_doc) == 40


#: Odd rows: no text, no words, a key twice, no key, other scripts, letters that not every Unicode version has.
ODD_TEXTS = [(1, "An old Stone, an old stone. A b c"), (1, "old stone"), (2, None), (3, " . a "), (None, "stone_1 OLD stone"), (None, "new"),
             (4, "Größe “größe” – İstanbul ΣΟΦΟΣ"), (5, "\u4e2d\u6587 \u0870\u0871x \u216b\u0664 \U00020000\U00020001 z\u0301z"), (6, "x" * 50 + " old")]


def _odd_texts(spark, monkeypatch):
    monkeypatch.setattr(C, "BYTES_AT_ONCE", 40)
    docs = spark.createDataFrame(ODD_TEXTS, "doc_id bigint, text string").coalesce(1)
    rows = [(i, r.doc_id, t) for i, r in enumerate(docs.select("doc_id", C.terms_of("text").alias("t")).collect()) for t in r.t or []]
    return docs, Counter(rows)


def test_terms_are_counted_without_a_row_per_term(spark, monkeypatch):
    docs, want = _odd_texts(spark, monkeypatch)
    counts = C.term_counts_in_row(docs, "text", "doc_id")
    assert Counter((r.doc_id, r.term, r.tf) for r in counts.collect()) == Counter((k, t, n) for (_, k, t), n in want.items())
    tf, df = Counter(), Counter()
    for (_, _, t), n in want.items():
        tf[t] += n
        df[t] += 1
    table = C.idf_table(docs)
    got = table.collect()
    assert {r.term: (r.tf, r.df) for r in got} == {t: (tf[t], df[t]) for t in tf} and len(got) == len(tf)
    assert all(r.idf == pytest.approx(math.log((1 + len(ODD_TEXTS)) / (1 + r.df)) + 1, rel=1e-12) for r in got)
    plan = table._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan and "hashpartitioning(term#" not in plan


def test_weights_are_joined_by_groups_of_terms(spark, monkeypatch):
    docs, want = _odd_texts(spark, monkeypatch)
    idf = C.idf_table(docs).filter("term != 'stone'").unionByName(spark.sql("SELECT 'nowhere' AS term, 1L AS tf, 1L AS df, 1D AS idf"))
    known = {r.term: r.idf for r in idf.collect()}
    x = [(k, t, (1 + math.log(n)) * known[t]) for (_, k, t), n in want.items() if t in known]
    length = Counter()
    for k, _, w in x:
        length[k] += w * w
    features = C.tfidf_features(docs, idf)
    got = sorted(((str(r.doc_id), r.term, r.weight) for r in features.collect()))
    expected = sorted((str(k), t, w / math.sqrt(length[k])) for k, t, w in x)
    assert [r[:2] for r in got] == [r[:2] for r in expected] and [r[2] for r in got] == pytest.approx([r[2] for r in expected], rel=1e-9)
    plan = features._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "collect_list" not in plan and "Join" not in plan.partition("== Physical Plan ==")[2]


def test_the_fit_is_at_the_optimum_of_its_penalised_likelihood(spark):
    """The gradient of mean loss plus penalty vanishes at the trained weights, and features equal the relational ones."""
    import numpy as np

    labelled = C.training_texts(spark)
    terms, intercepts, classes = C.train(labelled)
    rows = terms.collect()
    points = C._points(labelled, [r.term for r in rows], [r.idf for r in rows])
    x = np.array([p.features.toArray() for p in points.collect()])
    y = np.array([int(p.label) for p in points.collect()])
    want = {(r.doc_id, r.term): r.weight for r in C.tfidf_features(labelled, terms).collect()}
    at = {r.term: i for i, r in enumerate(rows)}
    docs = [r.doc_id for r in labelled.collect()]
    assert all(abs(x[docs.index(d), at[t]] - w) < 1e-9 for (d, t), w in want.items()) and (x > 0).sum() == len(want)
    w, b = np.array([r.weights for r in rows]).T, np.array(intercepts)
    margins = x @ w.T + b
    p = np.exp(margins - margins.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    gap = p - np.eye(classes)[y]
    assert np.abs(gap.T @ x / len(y) + w / len(y)).max() < 1e-3 and np.abs(gap.mean(0)).max() < 1e-3


def test_regions_without_their_words_have_the_same_counts(spark):
    rows = [(d, 0, r, "text", "paddle", i, t, 0.5 + 0.1 * r, 0.0, 0.0, 0.1, 0.1)
            for d, r, i, t in ((1, 0, 0, "one"), (1, 0, 1, " "), (1, 0, 2, "three"), (1, 1, 0, " "), (2, 0, 0, None), (2, 1, 0, "é"))]
    words = spark.createDataFrame(rows, "doc_id bigint, page int, region int, region_type string, engine string, word_idx int, text string, "
                                        "confidence double, x double, y double, width double, height double")
    whole, counts = [O.region_rollup(O.select_engine(O.engine_regions(words, w))) for w in (True, False)]
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, whole.select(*counts.columns).collect()))
    assert "collect_list(struct(word_idx" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_packed_where_they_are_read_and_put_in_order_afterwards(spark):
    """Regions in pieces, equal keys in two documents, blank and missing values; texts keep two fields of a word."""
    rows = [(d, 0, r, "text", e, i, f"{e[0]}{i}" if i % 7 else (" " if i else None), None if i == 3 else c + i / 1e6, i / 8, 0.0, 0.1, 0.1)
            for d in (1, 1, None) for r in (0, 1) for e, c in (("paddle", 0.5), ("easyocr", 0.6), ("tesseract", 0.9 - r / 2)) for i in range(40)]
    words = spark.createDataFrame(rows, "doc_id bigint, page int, region int, region_type string, engine string, word_idx int, text string, "
                                        "confidence double, x double, y double, width double, height double").repartition(3)
    packed = O.pack_words(words)
    assert packed.count() <= 3 * 12 and packed.select(F.sum(F.size("word_idx"))).first()[0] == len(rows)
    assert "mapinarrow" in O.engine_regions(words)._jdf.queryExecution().optimizedPlan().toString().lower()
    chosen = O.select_engine(O.engine_regions(words))
    got = {(r.doc_id, r.region): r for r in chosen.collect()}
    assert set(got) == {(1, 0), (1, 1), (None, 0), (None, 1)}
    for (d, region), r in got.items():
        engine, c = ("tesseract", 0.9) if region == 0 else ("easyocr", 0.6)
        mine = [x for x in rows if x[0] == d and x[2] == region and x[4] == engine]
        assert r.engine == engine and abs(r.confidence - sum(x[7] for x in mine if x[7]) / (len(mine) * 39 / 40)) < 1e-12
        low = lambda t: tuple((x is not None, x if x is not None else 0) for x in t)
        assert [tuple(w) for w in r.words] == sorted((x[5:] for x in mine), key=low)
    texts = O.region_rollup(O.select_engine(O.engine_regions(words, fields=("word_idx", "text"))))
    whole = O.region_rollup(chosen)
    columns = [c for c in texts.columns if c != "words"]
    assert sorted(map(str, texts.select(*columns).collect())) == sorted(map(str, whole.select(*columns).collect()))


def test_sums_of_confidences_are_exact(spark):
    values = [0.1, 0.7, 0.8450005, 0.1234565, -0.0000005, 0.0, None, 999.999999, 1000.0000005, 123456789.1234567, 1e-9, 0.30000000000000004]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values * 3)] + [(7, None)], "k int, v double")
    total, n = O.exact_sum(F.col("v"))
    plain = F.col("v").cast("decimal(18,6)")
    rows = df.groupBy("k").agg(total.alias("a"), F.sum(plain).alias("b"), n.alias("n"), F.count(plain).alias("m")).collect()
    assert len(rows) == 4 and all((r.a, r.n) == (r.b, r.m) for r in rows)


def test_more_engines_shuffle_counts(spark, sf):
    from papertrawl import plans

    plan = plans.queries()["ocr_more_engines"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "collect_list(struct(word_idx" not in plan


def test_characters_of_odd_words(spark):
    words = ["a", "!", "~x", "\x7f", " ", " ", " b", "é", "", "\t\n", "₹5"]
    df = spark.createDataFrame([(1, 0, 0, "text", i, w, "paddle", 0.5) for i, w in enumerate(words)],
                               "doc_id int, page int, region int, region_type string, word_idx int, text string, engine string, confidence double")
    plain = O.region_rollup(O.select_engine(O.engine_regions(df, True, ("word_idx", "text")))).first()
    counts = O.region_rollup(O.select_engine(O.engine_regions(df, False))).first()
    assert (counts.tokens, counts.characters, counts.confidence) == (plain.tokens, plain.characters, plain.confidence)
