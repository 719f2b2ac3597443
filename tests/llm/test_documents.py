"""Operators that judge, read or place single documents."""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken

from duskwatch.llm import bpe, cotraining, html_text, licenses, quality_rules, sharding

SCHEMA = "doc_id bigint, text string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    None, "", " ", "\n\n", "it's  über-große naïve\r\n\tZürich", "a" * 3000, "=" * 700 + " x", "日本語テキスト 12345 ½", "​\x1c\x00end",
    "ab" * 900, "don't DON'T we'll", "word " * 5000,
]


# --- byte-level BPE --------------------------------------------------------------


def test_bpe_equals_the_library_and_decodes(spark):
    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame(list(enumerate(ODD)), SCHEMA)
    rows = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert len(rows) == len(ODD)
    for row in rows:
        text = ODD[row.doc_id] or ""
        assert row.ids == library.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()


def test_encoder_numbers_each_word_once_and_forgets(monkeypatch):
    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN, bpe.merge_table(ranks))
    texts = ["Ungbersche reanouat Ungbersche", "", "reanouat thwhening", "a" * 3000]
    want = [library.encode_ordinary(t) for t in texts]
    assert encoder.encode(texts).to_pylist() == want
    held = dict(encoder.numbers)
    monkeypatch.setattr(encoder, "_contract", None)  # nothing new to contract
    assert encoder.encode(texts[::-1]).to_pylist() == want[::-1] and encoder.numbers == held
    monkeypatch.undo()
    monkeypatch.setattr(bpe, "REMEMBERED", 1)
    assert encoder.encode(texts[:1]).to_pylist() == want[:1] and len(encoder.numbers) == 3
    assert encoder.encode([]).to_pylist() == []


def test_bpe_round_trip_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame(
        [("x", 1, "one two", 7, "q"), (None, None, None, None, None)], "ids string, doc_id bigint, text string, _null int, decoded string"
    )
    found = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)
    assert found.columns == ["doc_id", "text", "_null", "decoded", "ids", "n_tokens"]
    assert sorted((r.text or "", r._null or 0, r.decoded or "", r.n_tokens) for r in found.collect()) == [
        ("", 0, "", 0), ("one two", 7, "q", 2),
    ]
    assert bpe.round_trip(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_ids_outside_the_vocabulary_are_an_error(spark):
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([([999_999],)], "ids array<int>"), RANKS).collect()


# --- licences --------------------------------------------------------------------


def simple_base(text: str):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    spots, labels = [], set()
    for phrase, label in licenses.BASE:
        want = phrase.split(" ")
        for i in range(len(words) - len(want) + 1):
            if words[i : i + len(want)] == want:
                spots.append(i)
                labels.add(label)
    return (
        len(words), len(spots), min(spots, default=None), max(spots, default=None), ",".join(sorted(labels)),
    )


def test_licences_match_brute_force(spark):
    texts = [
        "Released under the MIT License.", "x Under-the (MIT) license, under the mit license", "under the maKit license",
        "the mit license", "Licensed under the Apache License, Version 2.0.", "apache license version 20", "CC BY-NC 4.0",
        "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:", "nothing here mit dem Hut", None, "", "İstanbul cc BY nc", "word " * 2000,
    ]
    texts += [f"plain text number {i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).selectExpr("*", "'s' AS score", "doc_id AS _hits")
    found = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, text in enumerate(texts):
        row = found[i]
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == simple_base(text), text
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(","))
        assert 0.0 <= row.score <= 1.0 and (row.score > 0) == bool(row.labels)
        assert row["_hits"] == i
    assert found[7].labels == "gpl" and found[8].labels == "all-rights-reserved" and found[9].labels == "bsd"
    assert found[11].labels == "" and licenses.scan(docs.limit(0)).count() == 0


def test_one_indexed_word_very_often_in_one_text(spark):
    notice = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    texts = ["redistribution binary " * 20_000 + notice, notice] + [f"plain text number {i}" for i in range(40)]
    found = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert found[0][0] == found[1][0] == "bsd" and found[0][1] == pytest.approx(found[1][1])


# --- shards ----------------------------------------------------------------------


def test_shards_are_near_equal_and_slots_gapless(spark):
    draw = random.Random(2)
    texts = ["same text"] * 700 + ["x" * draw.randint(0, 300) for _ in range(1200)] + [None] * 5
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    rows += [(3, "same text")] * 200  # repeated rows
    found = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA), 8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    sizes = Counter()
    slots: dict[int, list[int]] = {}
    for r in found:
        sizes[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    mean = sum(sizes.values()) / 8
    assert set(sizes) == set(range(8)) and max(abs(v - mean) for v in sizes.values()) <= 301
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_empty_and_tiny_tables(spark):
    docs = spark.createDataFrame([(1, "a")], SCHEMA)
    assert [(r.shard, r.slot) for r in sharding.shard_documents(docs).collect()] in [[(s, 0)] for s in range(8)]
    assert sharding.shard_documents(docs.limit(0)).count() == 0


# --- html ------------------------------------------------------------------------


def test_main_text_leaves_the_frame_of_the_page_out():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h2>Site</h2></header><nav><ul><li><a href="/">Home, a, b, c</a></li></ul></nav><div class="cookie-notice">We use cookies, really, often, always.</div>
    <div id="content"><div class="post"><h1>Ti&amp;tle</h1><p>First, long   paragraph, with\ncommas, and <b>bold <i>text</b></i>.<br>Second line &eacute;.
    <p>Next one without an end tag, also, with, commas.<ul><li>Item one, first.<li>Item two, second.</ul></div>
    <div class="comments"><p>Great article, thanks, a lot, really, good, nice!</p></div></div>
    <aside><p>Related, more, things, to, read, here.</p></aside><form><p>Name, mail, and, so, on.</p></form><!-- <p>no</p> -->
    <div class="ad">Buy, now, cheap, stuff.</div><footer>&copy; 2024, all, rights.</footer></body></html>"""
    assert html_text.main_text(page).split("\n") == [
        "Ti&tle", "First, long paragraph, with commas, and bold text. Second line é.",
        "Next one without an end tag, also, with, commas.", "Item one, first.", "Item two, second.",
    ]


@pytest.mark.parametrize("page", ["", " ", "<", "<p", "<html></html>", "<!-- ", "<script>x", "</p></div>", "<div>" * 5000, "&#xZZ;&amp"])
def test_broken_pages_do_not_crash(page):
    assert isinstance(html_text.main_text(page), str)


def test_deep_and_plain_pages():
    assert html_text.main_text("<div>" * 3000 + "<p>One, two, three.</p>") == "One, two, three."
    assert html_text.main_text("just text, no tags") == "just text, no tags"
    assert html_text.main_text("<article><h1>Head</h1></article><footer>f</footer>") == "Head"


ARTICLE = "<h1>Head line</h1><p>First, long, paragraph with words, and more of them.</p><p>Second one, also here.</p>"
FRAME = "<body><div class='nav'><a href='/'>Home</a></div>{}<div class='footer'>All rights, reserved.</div></body>"


@pytest.mark.parametrize(
    "opening, end",
    [
        ('<div class="main-content with-sidebar">', "</div>"), ('<div id="story-with-comments">', "</div>"),
        ('<div class="elementor-widget elementor-widget-text">', "</div>"), ('<div class="two side">', "</div>"),
        ('<div class="elementor-widget"><article>', "</article></div>"), ('<div class="two side"><div class="widget">', "</div></div>"),
    ],
)
def test_names_do_not_cut_what_is_around_the_article(opening, end):
    assert html_text.main_text(FRAME.format(opening + ARTICLE + end)).split("\n") == [
        "Head line", "First, long, paragraph with words, and more of them.", "Second one, also here.",
    ]


def test_names_of_paragraphs_and_short_sections():
    page = FRAME.format(f"<article>{ARTICLE}<p class='navy'>Blue text.</p><p class='share'>A share of it.</p><p class='ad'>Buy.</p></article>")
    assert html_text.main_text(page).split("\n")[3:] == ["Blue text.", "A share of it."]
    page = FRAME.format(f"<div><section>{ARTICLE * 3}</section><section><h2>End</h2><p>Short one.</p></section></div>")
    assert html_text.main_text(page).split("\n")[9:] == ["End", "Short one."]


def test_long_comments_and_notices_stay_out():
    readers = "<article class='comment-body'><p>I, for one, think, that, this, is, a, long, comment.</p></article>" * 20
    notice = "<p>We use cookies, and more, to see, what, you, read, on, this, site, now.</p>" * 2
    page = FRAME.format(f"<div class='post'>{ARTICLE}</div><div id='comments'>{readers}</div><div class='cookie-notice'>{notice}</div>")
    assert html_text.main_text(page).split("\n")[0] == "Head line"
    assert "cookies" not in html_text.main_text(page) and "for one" not in html_text.main_text(page)


def test_extract_handles_nulls_and_counts_code_points(spark):
    pages = spark.createDataFrame(
        [(1, "u", "<p>é, 😀</p>", "x"), (2, None, None, "x"), (2, None, None, "x"), (None, "v", "", None)],
        "page_id bigint, url string, html string, text string",
    )
    found = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract(pages).collect())
    assert found == [(0, "", 0), (1, "é, 😀", 4), (2, "", 0), (2, "", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_pages_of_the_table_give_their_article(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    texts = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for row in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer)", row.html, re.S)[1]
        parts = [html.unescape(re.sub(r"<[^>]*>", " ", p)) for p in re.split(r"</?(?:h1|p)>", inner)]
        blocks = [b for b in (re.sub(r"\s+", " ", p).strip() for p in parts) if b]
        assert texts[row.page_id] == "\n".join(blocks)


# --- quality ---------------------------------------------------------------------


def simple_statistics(text: str | None):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts, covered = Counter(grams), set()
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            covered.update(range(i, i + 8))
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered),
    )


def prose(draw: random.Random, words: int) -> str:
    return " ".join("".join(draw.choices("etaoinshr", k=draw.randint(2, 8))) for _ in range(words)).capitalize() + "."


def labelled(draw: random.Random):
    texts, quality = [], []
    for i in range(300):
        text = prose(draw, draw.randint(30, 200))
        bad = i % 6 == 0
        if bad:
            text = text.upper() if i % 12 else " ".join(f"{w}{draw.choice(['***', '$$$', '###'])}" for w in text.split())
        texts.append(text)
        quality.append(int(not bad))
    return texts, quality


def test_statistics_match_brute_force(spark):
    draw = random.Random(6)
    texts = ODD + [prose(draw, 60) + "\nsame line\n \nsame line\n" + "a b c d e f g h " * draw.randint(0, 3) for _ in range(30)]
    parity = [bin(i).count("1") % 2 for i in range(4096)]  # one value modulo a power of two, both ways round
    texts += ["\n".join("".join("ab"[bit ^ flip] for bit in parity) + " tail" * 7 for flip in (0, 1))]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int")
    for row in quality_rules.judge(docs, labels).collect():
        want = simple_statistics(texts[row.doc_id])
        assert tuple(row[c] for c in quality_rules.COUNTS) == want, texts[row.doc_id]
        assert row.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (row.base_failed and row.kept)


def shares_kept(spark):
    texts, quality = labelled(random.Random(7))
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    labels = spark.createDataFrame([(i, q, 0) for i, q in enumerate(quality) if i % 2 == 0], "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs, labels).collect()}
    good = [kept[i] for i, q in enumerate(quality) if q]
    bad = [kept[i] for i, q in enumerate(quality) if not q]
    return np.mean(good), np.mean(bad), docs, labels


@pytest.mark.xfail(reason="known gap: 86 per cent of these odd documents were kept; see README")
def test_forest_rejects_most_odd_documents(spark):
    assert shares_kept(spark)[1] < 0.2


def test_forest_keeps_clean_documents(spark):
    good, _, docs, labels = shares_kept(spark)
    assert good > 0.97
    nothing = quality_rules.judge(docs.limit(0), labels)
    assert nothing.count() == 0


def test_forest_path_lengths_match_a_walk():
    draw = np.random.default_rng(5)
    rows = draw.normal(size=(200, 4))
    forest = quality_rules.fit_forest(rows, 5, 64)
    scores = quality_rules.forest_scores(forest, rows[:20])
    for row, score in zip(rows, scores):
        total = 0.0
        for tree in range(5):
            node = 1
            while forest["feature"][tree, node] >= 0:
                node = 2 * node + (row[forest["feature"][tree, node]] >= forest["cut"][tree, node])
            total += forest["length"][tree, node]
        assert score == pytest.approx(2 ** (-total / 5 / quality_rules._average_path(64.0)))


def test_co_training_learns_exchanges_and_holds_out(spark):
    draw = random.Random(9)
    texts, quality = labelled(draw)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, p_good int"
    rows = [(i, t, "en", f"src{i % 5}" if q else "junk", len(t), "k", 1) for i, (t, q) in enumerate(zip(texts, quality))]
    rows += [(None, None, None, None, None, None, None), rows[0]]
    docs = spark.createDataFrame(rows, schema)
    known = [(i, q, 0) for i, q in enumerate(quality) if i % 2 == 0]
    labels = spark.createDataFrame(known + [(1, None, None)], "doc_id bigint, quality int, toxic int")
    model = cotraining.fit(docs, labels)
    assert model.exchanged > 0
    found = cotraining.score(docs, model)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "p_text", "p_meta", "p_good", "kept"]
    rows = found.collect()
    assert len(rows) == 302
    hidden = [(r.kept, quality[r.doc_id]) for r in rows if r.doc_id is not None and r.doc_id % 2]
    assert np.mean([k == bool(q) for k, q in hidden]) > 0.95
    assert cotraining.classify(docs, labels.limit(0)).where("NOT kept").count() == 0
    assert cotraining.classify(docs.limit(0), labels).count() == 0


def test_few_labels_in_many_documents_give_a_model_like_the_unsampled_fit(spark):
    draw = random.Random(12)
    rows = []
    for i in range(4000):
        bad = i % 5 == 0
        text = prose(draw, draw.randint(20, 60))
        rows.append((i, text.upper() if bad else text, "en", "junk" if bad and i % 3 else f"src{i % 7}", len(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(8)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 4000, 16)], "doc_id bigint, quality int, toxic int")
    kept = []
    for limits in ({}, {"fit_rows": 90, "handed_rows": 60}):
        model = cotraining.fit(docs, labels, **limits)
        assert model.exchanged > 500
        kept.append({r.doc_id: r.kept for r in cotraining.score(docs, model).select("doc_id", "kept").collect()})
        assert np.mean([k == bool(i % 5) for i, k in kept[-1].items()]) > 0.97
    assert np.mean([kept[0][i] == kept[1][i] for i in kept[0]]) > 0.97


def test_views_are_separate():
    texts = [b"one two", b"THREE\n\nfour"]
    assert cotraining._views(*map(pd.Series, (texts, ["en"] * 2, [None] * 2, [3.0] * 2)))[
        :, cotraining.text_view([b""]).shape[1] :
    ].std(axis=0).max() == 0
