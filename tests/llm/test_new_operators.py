"""Pieces, ranked search and the prefix trie against the library, brute force and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from papertrawl.llm import lexical, pieces, trie
from papertrawl.llm.scan import running

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("rank", "score", "ids", "term", "place", "range", "opens", "length", "depth", "weight")


# ---- pieces -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    with open(pieces.default_model(), "rb") as f:
        return pieces.Pieces(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_same_ids_and_texts_as_the_library(model, library):
    draw = random.Random(7)
    pool = [*" \n\t\r▁  ab.", "the", "ing", "​", "é", "日本", "😀", "\0", "<s>", "<0x0A>", "</s>", "<unk>", "▁▁", "   ", "�",
            "ß", "ы", "है", "return", " " * 17, *model.tokens[::41]]
    for _ in range(8000):
        text = "".join(draw.choice(pool) for _ in range(draw.randint(0, 14)))
        ids = model.encode(text, True)
        assert ids.tolist() == [*library.encode(text), library.eos_id()], text
        assert model.decode(ids) == library.decode(ids.tolist()), text


def test_long_words_without_cuts(model, library):
    draw = random.Random(8)
    for text in ("ab" * 20_000, "".join(draw.choice("abcdefgh") for _ in range(20_000)), "日本語の文章" * 3000, " " * 5000, "\n" * 5000):
        assert model.encode(text).tolist() == library.encode(text)


def test_any_ids_are_read_as_the_library_reads_them(model, library):
    draw = random.Random(9)
    for _ in range(2000):  # byte pieces in any order, control pieces, unknown
        ids = [draw.randrange(32_000) if draw.random() < 0.6 else draw.randrange(300) for _ in range(draw.randint(0, 10))]
        assert model.decode(np.array(ids, np.int32)) == library.decode(ids), ids


def test_two_tokens_go_together_exactly_if_merging_leaves_them(model, library):
    draw = random.Random(10)
    seen = set()
    words = [t for t in model.tokens if 2 <= len(t) <= 6 and not t.startswith("▁")]
    for _ in range(3000):
        a, b = draw.choice(words), draw.choice(words)
        want = library.encode("\n" + a + b)[2:] == [model.id[a], model.id[b]]  # behind a character that no piece contains
        got = model._fit(model.tokens.index(a), model.tokens.index(b))
        assert got == want, (a, b)
        seen.add(got)
    assert seen == {True, False}


def test_encode_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (None, "same text"), (None, "same text"), (3, " "), (4, "x" * 300_000), (5, "😀 ok")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("theirs") for c in CLASH})
    found = sorted(((r.doc_id or 0, r.ids, r.text) for r in pieces.decode(pieces.encode(docs)).collect()))
    want = sorted(((d or 0, [*library.encode(t or ""), 2], library.decode(library.encode(t or ""))) for d, t in rows))
    assert found == want
    assert pieces.encode(docs.limit(0)).count() == 0 and pieces.decode(pieces.encode(docs.limit(0))).count() == 0


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Pieces(b"\x0a\x08\x0a\x01a\x15\x00\x00\x00\x00")


# ---- ranked search ----------------------------------------------------------------------------------


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked_by_hand(docs, items, k):
    lists = [(d, plain_terms(t)) for d, t in docs]
    lists = [(d, w) for d, w in lists if w]
    n, total = len(lists), sum(len(w) for _, w in lists)
    df = Counter(t for _, w in lists for t in set(w))
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(plain_terms(t))
    out = {}
    for i, terms in wanted.items():
        scores = []
        for d, w in lists:
            m, tf = 50 + 50 * len(w) * n // total, Counter(w)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m))
                    for t in terms if tf[t])
            if s > 0:
                scores.append((-s, d is None, d))
        if scores:
            out[i] = [(d, -s) for s, _, d in sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k]]
    return out


@pytest.mark.parametrize(("points", "most_docs", "k"), [(1 << 20, 1 << 16, 50), (200, 1 << 16, 7), (1 << 20, 5, 3), (1, 1, 50)])
def test_ranks_like_brute_force(spark, points, most_docs, k):
    draw = random.Random(points + k)
    vocabulary = [f"t{i}" for i in range(400)] + ["Über", "日本", "x9", "ΑΒΓ"]
    docs = [(d, " ".join(draw.choice(vocabulary[:draw.choice((5, 60, 404))]) for _ in range(draw.randint(0, 120)))) for d in range(150)]
    docs += [(1000 + d, docs[3][1]) for d in range(80)]  # a large tie
    draw.shuffle(docs)
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 20)))) for i in range(12)] + [(50, docs[0][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    total = lexical.counts(table)
    index = lexical.build(table, total, points, most_docs)
    for slice_bytes in (lexical.SLICE_BYTES, 300):
        found = defaultdict(list)
        for r in lexical.search(index, total[0], asked, k, slice_bytes).orderBy("item_id", "rank").collect():
            found[r.item_id].append((r.doc_id, r.score))
            assert r["rank"] == len(found[r.item_id])
        assert found == ranked_by_hand(docs, items, k)


def test_levels_hold_the_maxima_of_their_cells():
    draw = np.random.default_rng(3)
    points = np.unique(draw.integers(0, 64, (300, 2)), axis=0)
    values = draw.integers(1, 1_000_000, len(points))
    grid = lexical.Grid(lexical.pack_levels(lexical.grid_levels(points[:, 0], points[:, 1], values, 6)))
    for row in range(64):
        cells, ranges = np.zeros((1, 1), np.int64), [0]
        for level in range(6):
            bit = np.array([(row >> (5 - level)) & 1])
            cells = np.concatenate([grid.open(level, cells, bit, side) for side in (0, 1)])
            ranges = [2 * r + side for side in (0, 1) for r in ranges]
            width = 5 - level
            for cell, r in zip(cells[:, 0], ranges, strict=True):
                inside = ((points[:, 0] >> width) == row >> width) & ((points[:, 1] >> width) == r)
                assert grid.levels[level + 1][0][cell] == (values[inside].max() if inside.any() else 0)


def test_good_bounds_leave_ranges_closed():
    """One row of large impacts and many small ones: the search opens a small part of the documents."""
    docs = np.arange(1 << 16)
    grid = lexical.Grid(lexical.pack_levels(lexical.grid_levels(np.zeros(1 << 16, np.int64), docs, 1000 + (docs == 77) * 9000, 16)))
    best = lexical.Best(1)
    looked = lexical.search_grid(grid, docs, np.array([0]), np.array([3]), best)
    assert best.ids.tolist() == [77] and best.scores.tolist() == [30_000] and looked < 9000


def test_search_odd_rows(spark):
    rows = [(1, "alpha beta"), (1, "alpha beta"), (2, None), (3, ""), (None, "Alpha, gamma"), (4, "-- !"), (5, "beta " * 50_000), (6, "delta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("theirs") for c in CLASH})
    items = [(1, "ALPHA"), (1, "gamma"), (2, None), (3, "nothing"), (None, "beta; beta"), (4, "")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("theirs"))
    found = defaultdict(list)
    for r in lexical.ranked_search(docs, asked).orderBy("item_id", "rank").collect():
        found[r.item_id].append((r.doc_id, r.score))
    assert found == ranked_by_hand(rows, items, 50)
    assert lexical.ranked_search(docs.limit(0), asked).count() == 0 and lexical.ranked_search(docs, asked.limit(0)).count() == 0


# ---- prefix trie ------------------------------------------------------------------------------------


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    out = set()
    for path, members in nodes.items():
        under = [p for p in nodes if p[:len(path)] == path]
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(path))))
        out.add((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
                 sum(len(p) == len(path) + 1 for p in under),
                 sum(not any(q[:len(p)] == p and len(q) > len(p) for q in under) for p in under),
                 sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in under if p), hashlib.sha256(ends.encode()).hexdigest()))
    return out


FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("seed", range(3))
def test_trie_like_brute_force(spark, seed):
    draw = random.Random(seed)
    said = ["", "a", "bé", "c c", "日本"]
    rows = [(c, draw.choice((t, t, t // 2, None)), draw.choice(("user", "assistant")), draw.choice(said[:draw.choice((1, 2, 5))]))
            for c in range(-20, 60) for t in range(draw.choice((1, 2, 3, 9, 14)))]
    found = trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    assert {tuple(r[f] for f in FIELDS) for r in found} == trie_by_hand(rows) and len(found) == len(trie_by_hand(rows))


def test_trie_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (7, None, None, None), (7, None, None, None), (3, 1, "user", "y" * 200_000)]
    rows += [(c, t, "user", f"turn {t}") for c in range(100, 130) for t in range(12)]  # copies of one conversation
    rows += [(50, t, "user", "ha") for t in range(3000)]  # one with very many turns
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("t") for c in CLASH})
    found = {tuple(r[f] for f in FIELDS) for r in trie.prefix_trie(turns).collect()}
    small = [r for r in rows if r[0] != 50 or r[1] < 30]
    assert len(found) == len(trie_by_hand(small)) + 3000 - 30
    assert {r for r in found if r[0] != 50 and r[1]} == {r for r in trie_by_hand(small) if r[0] != 50 and r[1]}
    assert trie.prefix_trie(turns.limit(0)).count() == 0


def test_end_list_of_many_conversations(spark):
    ids = spark.range(200_000).select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("x1"),
                                      F.lit(0).cast("long").alias("x2"), F.col("id").alias("conv_id"))
    [row] = trie.end_lists(ids).collect()
    assert row.ends_sha256 == hashlib.sha256(",".join(map(str, range(200_000))).encode()).hexdigest()


def test_running_totals_of_a_key_across_ranges(spark):
    draw = random.Random(4)
    rows = [(draw.choice((1, 1, 1, 2, -5)), k, draw.randrange(-1000, 1000), draw.getrandbits(63)) for k in range(5000)]
    table = spark.createDataFrame(rows, "k long, o long, v long, x long").repartition(5)
    found = {r.o: (r.place, r.run_v, r.run_x) for r in running(table, "k", [F.col("o")], ["o"], ["v"], ["x"]).collect()}
    totals = defaultdict(lambda: [0, 0, 0])
    for k, o, v, x in rows:
        t = totals[k]
        t[0], t[1], t[2] = t[0] + 1, t[1] + v, t[2] ^ x
        assert found[o] == tuple(t)
