"""SimHash components and benchmark items against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
import xxhash

from duskwatch.llm import decontaminate, simhash

SCHEMA = "doc_id bigint, text string"


def simple_fingerprint(text: str | None, size: int = 3) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(fps: dict[int, int], distance: int) -> dict[int, int]:
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if b < a and (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("limit", [512, 4])
def test_components_match_brute_force(spark, limit):
    """A large cluster of close fingerprints; a low limit forces finer blocks."""
    draw = random.Random(4)
    base = [f"w{draw.randint(0, 500)}" for _ in range(150)]
    texts = {}
    for i in range(150):
        words = list(base) if i % 3 else [f"v{draw.randint(0, 900)}" for _ in range(60)]
        words[draw.randrange(len(words))] = f"x{i}"
        texts[i] = " ".join(words)
    texts |= {200: "", 201: None, 202: " \n", 203: "One", 204: "one", 205: "É é", 206: "é é"}
    docs = spark.createDataFrame(list(texts.items()), SCHEMA)
    found = simhash.near_duplicate_components(docs, limit=limit).collect()
    fps = {i: simple_fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: r.fp % (1 << 64) for r in found} == fps
    assert {r.doc_id: r.component_id for r in found} == smallest_reachable(fps, 3)


def test_one_of_each_component_stays(spark):
    schema = "root string, doc_id bigint, text string, fp int, component_id int"
    rows = [
        ("a", 4, "same text of a few words", 1, 1),
        ("b", 2, "same text of a few words", 1, 1),
        ("c", 2, "same text of a few words", 1, 1),
        ("d", None, "same text of a few words", 1, None),
        ("e", None, "alone with a null id here", 1, 1),
        ("f", 9, None, None, 1),
    ]
    docs = spark.createDataFrame(rows, schema)
    kept = simhash.keep_one_per_component(docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in found) == [
        (-1, "alone with a null id here"), (2, "same text of a few words"), (9, ""),
    ]
    assert simhash.keep_one_per_component(docs.limit(0)).count() == 0


def simple_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def simple_matches(docs, items, similarity=0.8, radius=19):
    found = {}
    for item_id, item in items:
        want = simple_words(item)
        if not want:
            continue
        size = min(5, len(want))
        shingles = lambda w: [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)]

        def fp(s):
            h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
            return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))

        own, own_fp = Counter(shingles(want)), fp(shingles(want))
        for doc_id, text in docs:
            words = simple_words(text)
            if len(words) < size:
                continue
            for at in range(max(1, len(words) - len(want) + 1)):
                part = shingles(words[at : at + len(want)])
                shared = sum((Counter(part) & own).values())
                alike = shared / (len(part) + own.total() - shared)
                apart = (fp(part) ^ own_fp).bit_count()
                if alike >= similarity and apart <= radius:
                    key = (alike, -apart, -at)
                    found[doc_id, item_id] = max(found.get((doc_id, item_id), key), key)
    return found


def test_benchmark_items_match_brute_force(spark):
    draw = random.Random(8)
    vocabulary = [f"t{i}" for i in range(300)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([3, 6, 9, 30, 45, 60])))) for i in range(24)]
    items += [(50, "a a a a a a a a a a"), (51, None), (52, "..."), (53, items[3][1]), (54, "lone")]
    docs = []
    for i in range(60):
        words = draw.choices(vocabulary, k=draw.randint(0, 120))
        passage = items[draw.randrange(24)][1].split()
        for _ in range(draw.randint(0, 2)):  # edits: replace, insert or delete a word
            at = draw.randrange(len(passage))
            passage[at : at + draw.randint(0, 1)] = draw.choices(vocabulary, k=draw.randint(0, 1))
        at = draw.randint(0, len(words))
        docs.append((i, " ".join(words[:at] + passage + words[at:]).title()))
    docs += [(100, "a " * 40), (101, None), (102, ""), (103, "a a a a a a a a a"), (104, "Lone!")]
    found = decontaminate.contaminated(
        spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")
    ).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, -r.distance, -r.first_word) for r in found} == simple_matches(
        docs, items
    )


def test_contaminated_documents_go_and_clean_ones_stay(spark):
    item = " ".join(f"q{i}" for i in range(20))
    items = spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string")
    schema = "item_id int, doc_id bigint, text string, _k1 int, length int"
    rows = [(1, 1, f"x {item} y", 1, 1), (1, None, item, 1, 1), (1, 2, "clean words only", 1, 1), (None, 3, None, None, None)]
    docs = spark.createDataFrame([*rows, rows[2]], schema)
    kept = decontaminate.remove_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 2, 3]
    assert decontaminate.remove_contaminated(docs, items.limit(0)).count() == 5
    assert decontaminate.remove_contaminated(docs.limit(0), items).count() == 0


def test_windows_in_another_order_match_brute_force(spark):
    draw = random.Random(12)
    item = [f"q{i}" for i in range(60)]
    thirds = [f"r{i}" for i in range(90)]
    items = [(1, " ".join(item)), (2, " ".join(thirds))]
    around = [" ".join(draw.choices([f"t{i}" for i in range(90)], k=80)) for _ in range(4)]
    docs = [
        (1, " ".join([around[0], *item[30:], *item[:30], around[1]])),
        (2, " ".join([around[2], *thirds[60:], *thirds[:30], *thirds[30:60], around[3]])),
        (3, " ".join(item[30:] + item[:30])),
        (4, " ".join([around[0], *item[:20], around[1]])),
    ]
    expected = simple_matches(docs, items)
    assert {d for d, _ in expected} >= {1, 3}
    found = decontaminate.contaminated(
        spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")
    ).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, -r.distance, -r.first_word) for r in found} == expected


@pytest.mark.parametrize("most, join", [(500_000, "BroadcastHashJoin"), (0, "ShuffledHashJoin")])
def test_texts_are_moved_only_where_keys_are_many(spark, monkeypatch, most, join):
    """A document of repeated rows is one, and texts are neither sorted nor, with few keys, shuffled."""
    draw = random.Random(3)
    item = [f"q{i}" for i in range(40)]
    around = draw.choices([f"t{i}" for i in range(90)], k=200)
    docs = [(i, " ".join(around[: 20 * i] + item + around[20 * i :])) for i in range(5)]
    docs += [(None, docs[2][1]), (7, " ".join(around)), (8, " ".join(item[:30])), (9, None), (10, "")]
    items = [(1, " ".join(item)), (2, " ".join(item[:12]))]
    expected = simple_matches(docs, items)
    kept, plans = {}, {}
    store = decontaminate.stored

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        kept[name] = store(df, name)
        return kept[name]

    monkeypatch.setattr(decontaminate, "stored", watched)
    monkeypatch.setattr(decontaminate, "BROADCAST_DOCUMENTS", most)
    counts = []
    for times in (1, 6):
        found = decontaminate.contaminated(
            spark.createDataFrame(docs * times, SCHEMA).repartition(3),
            spark.createDataFrame(items, "item_id bigint, text string"),
        ).collect()
        assert len(found) == len(expected)
        assert {(r.doc_id, r.item_id): (r.similarity, -r.distance, -r.first_word) for r in found} == expected
        counts.append(kept["windows"].count())
        assert f"{join} [" in plans["texts"] and "SortMergeJoin" not in plans["texts"]
        assert ("hashpartitioning" in plans["texts"]) == (most == 0)
    assert counts[0] == counts[1]
