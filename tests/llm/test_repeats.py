"""Repeated passages (words) and substrings (bytes) against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from duskwatch.llm import debruijn, suffix_array

SCHEMA = "doc_id bigint, text string"


def places(texts, cut, window):
    found = defaultdict(int)
    for symbols in map(cut, texts):
        for i in range(len(symbols) - window + 1):
            found[tuple(symbols[i : i + window])] += 1
    return found


def removed_all(texts, cut, window):
    """Symbols of every text covered by a window that starts at two places or more."""
    found = places(texts, cut, window)
    marks = []
    for symbols in map(cut, texts):
        mask = [False] * len(symbols)
        for i in range(len(symbols) - window + 1):
            if found[tuple(symbols[i : i + window])] > 1:
                mask[i : i + window] = [True] * window
        marks.append(mask)
    return marks


def removed_later(texts, cut, window):
    """Texts in document order: symbols covered by a window that starts earlier."""
    seen, marks = set(), []
    for symbols in map(cut, texts):
        mask = [False] * len(symbols)
        for i in range(len(symbols) - window + 1):
            key = tuple(symbols[i : i + window])
            if key in seen:
                mask[i : i + window] = [True] * window
            seen.add(key)
        marks.append(mask)
    return marks


def corpus(seed: int, words: int = 400) -> list[str]:
    """Shared passages at odd places, monotonous texts, copies and near copies."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcdé", k=draw.randint(1, 4))) for _ in range(60)]
    passage = [draw.choice(vocabulary) for _ in range(90)]
    texts = []
    for i in range(24):
        own = [draw.choice(vocabulary) for _ in range(draw.randint(1, words))]
        if i % 3 == 0:
            a, b = sorted((draw.randint(0, 90), draw.randint(0, 90)))
            at = draw.randint(0, len(own))
            own[at:at] = passage[a:b]
        texts.append(draw.choice([" ", "\n", "  "]).join(own))
    # Thue-Morse words: every polynomial modulo a power of two gives both ways round one value.
    parity = [bin(i).count("1") % 2 for i in range(4096)]
    texts += ["".join("xy"[bit ^ flip] for bit in parity) + " one two three four five six seven eight nine ten eleven" for flip in (0, 1)]
    texts += [texts[0], texts[3] + " x", "a " * 300, "a " * 250 + "b", "ab " * 150, "z" * 700, "", " \n"]
    return texts


def as_words(text: str) -> list[str]:
    return text.split()


def as_bytes(text: str) -> bytes:
    return text.encode()


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("limit", [0, 1000])
def test_words_match_brute_force(spark, seed, keep_first, limit):
    texts = corpus(seed)
    rows = list(enumerate(texts))
    found = debruijn.deduplicate(spark.createDataFrame(rows, SCHEMA), 12, keep_first, gram=5, limit=limit).collect()
    marks = (removed_later if keep_first else removed_all)(texts, as_words, 12)
    for row in found:
        words, mask = as_words(texts[row.doc_id]), marks[row.doc_id]
        kept = " ".join(w for w, gone in zip(words, mask) if not gone)
        assert (row.n_words, row.n_removed) == (len(words), sum(mask)), row.doc_id
        assert bytes(row.kept) == kept.encode()
    assert sorted(r.doc_id for r in found) == list(range(len(texts)))


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("limit", [0, 1000])
def test_bytes_match_brute_force(spark, seed, keep_first, limit):
    texts = corpus(seed)
    rows = list(enumerate(texts))
    found = suffix_array.deduplicate(
        spark.createDataFrame(rows, SCHEMA), 40, keep_first, gram=16, limit=limit
    ).collect()
    marks = (removed_later if keep_first else removed_all)(texts, as_bytes, 40)
    for row in found:
        raw, mask = as_bytes(texts[row.doc_id]), marks[row.doc_id]
        kept = bytes(b for b, gone in zip(raw, mask) if not gone)
        runs = sum(gone and not (i and mask[i - 1]) for i, gone in enumerate(mask))
        assert (row.n_bytes, row.n_removed, row.n_spans) == (len(raw), sum(mask), runs), row.doc_id
        assert hashlib.sha256(bytes(row.kept)).digest() == hashlib.sha256(kept).digest()


@pytest.mark.parametrize("operator", [debruijn.deduplicate, suffix_array.deduplicate])
def test_nulls_repeated_rows_clashes_and_empty_tables(spark, operator):
    long = " ".join(f"w{i}" for i in range(200))
    schema = "kept string, doc_id bigint, text string, _k1 int, n_removed string, spans int, h int"
    rows = [
        ("a", 5, long, 1, "x", 1, 1),
        ("b", 5, long, 2, "x", 1, 1),  # equal in id and text: the same document
        ("c", None, long, 3, "x", 1, 1),  # a null id comes last
        ("d", 1, None, 4, "x", None, 1),
        ("e", 1, "", 5, "x", 1, None),
        (None, None, None, None, None, None, None),
    ]
    docs = spark.createDataFrame(rows, schema)
    found = {r["_k1"]: r for r in operator(docs, keep_first=True).collect()}
    assert len(found) == 6
    assert found[1].text == long and found[2].text == long
    assert found[3].text == "" and found[3].n_removed > 0
    assert found[4].text is None and found[4].n_removed == 0 and found[5].text == ""
    both = {r["_k1"]: r for r in operator(docs, keep_first=False).collect()}
    assert both[1].text == both[2].text == both[3].text == ""
    assert operator(docs.limit(0)).count() == 0


def match(data: bytes, i: int, j: int) -> int:
    n = 0
    while max(i, j) + n < len(data) and data[i + n] == data[j + n]:
        n += 1
    return n


def test_longest_previous_and_next_factors():
    draw = np.random.default_rng(3)
    for _ in range(40):
        data = draw.integers(97, 99, draw.integers(1, 40)).astype(np.uint8).tobytes()
        order = sorted(range(len(data)), key=lambda i: data[i:])
        common = np.array([0] + [match(data, a, b) for a, b in zip(order, order[1:])])
        previous = suffix_array.longest_previous_factors(np.array(order), common)
        following = suffix_array.longest_next_factors(np.array(order), common)
        for i in range(len(data)):
            assert previous[i] == max((match(data, i, j) for j in range(i)), default=0)
            assert following[i] == max((match(data, i, j) for j in range(i + 1, len(data))), default=0)


def test_ends_of_copied_passages(spark):
    """Runs at the ends differ as a whole, so only factors tell which of their windows repeat."""
    draw = random.Random(5)
    passage = "".join(draw.choices("abcdefgh", k=300))
    texts = ["".join(draw.choices("xyz", k=50)) + passage + c * 50 for c in "pqr"]
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    for keep_first, marks in ((False, removed_all), (True, removed_later)):
        found = suffix_array.deduplicate(rows, 40, keep_first, gram=16).collect()
        expected = [sum(mask) for mask in marks(texts, as_bytes, 40)]
        assert [r.n_removed for r in sorted(found)] == expected and sum(expected) >= 600


def test_runs_of_crowded_anchors_are_cut_once(spark):
    rows = list(enumerate(corpus(1)))
    found = suffix_array.deduplicate(spark.createDataFrame(rows, SCHEMA), 40, False, gram=16, limit=0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "MapInArrow cut(" not in plan and "MapInArrow windows(" not in plan


def test_op7_holds_small_batches(spark, tmp_path):
    """Whole texts wait on both sides of a Python worker, so op7 bounds its batches whatever the session says."""
    from duskwatch.llm.queries import op7

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    rows = [(1, "x" * 10), (2, None)]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    try:
        spark.conf.set(name, "10000")
        found = {r["doc_id"]: r["n_bytes"] for r in op7(spark, str(tmp_path)).collect()}
        assert found == {1: 10, 2: 0} and int(spark.conf.get(name)) <= 2048
    finally:
        spark.conf.set(name, held)


def test_replacement_characters_of_a_text_stay(spark):
    """Only code points broken by a cut go; a text without repeats leaves the pipeline's stage as it came."""
    import corpus_pipeline

    draw = random.Random(9)
    common = "".join(draw.choices("abcdefgh", k=500))
    clean = "one \ufffd two \ue000a \ue000b three"
    texts = [clean, f"p \ufffd \u00e9{common}", f"q \ufffd\ue000b \ue000\ufffda \u00a9{common}r \ufffd"]
    rows = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint")
    found = {r.doc_id: r for r in corpus_pipeline.repeated_substrings(spark, rows, "").collect()}
    # Both letters before the passage end in one byte, which is cut with it: the first byte of the later one is broken.
    expected = [*texts[:2], "q \ufffd\ue000b \ue000\ufffda r \ufffd"]
    assert [found[i].text for i in range(3)] == expected
    assert [found[i].n_chars for i in range(3)] == [len(t) for t in expected]
