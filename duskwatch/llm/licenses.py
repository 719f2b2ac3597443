"""Licence scans by a positional index of rare words, in DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import packed, unpacked

# What stands between words (ASCII other than letters and digits).
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Phrases whose every place is reported, and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Licence notices as lower-cased words, with the key phrase each must contain.
TEMPLATES = (
    ("mit", "released under the mit license", "under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        "permission is hereby granted free of charge",
    ),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc0-1", "to the extent possible under law the author has waived all copyright", "waived all copyright"),
    (
        "gpl",
        "this work is licensed under the gnu general public license version 3",
        "gnu general public license",
    ),
    (
        "lgpl",
        "under the terms of the gnu lesser general public license as published by the free software foundation",
        "gnu lesser general public license",
    ),
    (
        "agpl",
        "under the terms of the gnu affero general public license as published by the free software foundation",
        "gnu affero general public license",
    ),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "mozilla public license",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        "redistribution and use in source and binary forms",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "permission to use copy modify and or distribute",
    ),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
)
RARE_WORDS = 4
SHARE = 0.75


def words_of(column: str = "text") -> Column:
    """Lower-cased (A-Z) words of a text, in order; none for a null text.

    Only A to Z may change case. ``lower`` also changes letters outside ASCII, but
    those stay outside ASCII, where no licence word lies; the Kelvin sign, the one
    that would become an ASCII letter, is replaced first.
    """
    low = F.lower(F.replace(F.coalesce(F.col(column), F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.array_remove(F.split(low, SEPARATORS), "")


def _by_word(word: Column, values: dict[str, float]) -> Column:
    (first, value), *rest = values.items()
    return reduce(lambda c, item: c.when(word == item[0], item[1]), rest, F.when(word == first, value))


def _agreed_share(postings: dict[str, tuple[int, float]], text: list[str], key: list[str], least: float) -> Column:
    """The largest share of a notice's indexed IDF that agrees on one start, its key phrase verified."""
    offsets = {w: at for w, (at, _) in postings.items()}
    weights = {w: idf for w, (_, idf) in postings.items()}
    total, span = sum(weights.values()), len(text)
    starts = F.array_sort(
        F.transform(
            F.filter("_hits", lambda h: h["word"].isin(list(postings))),
            lambda h: F.struct(
                (h["at"] - _by_word(h["word"], offsets)).alias("at"), _by_word(h["word"], weights).alias("idf")
            ),
        )
    )

    def summed(held: Column) -> Column:
        """Distinct starts with their share. A word stands once in a notice, so no more hits than words share a start."""
        last = F.filter(
            F.sequence(F.lit(1), F.size(held)),
            lambda i: (i == F.size(held)) | (F.get(held, i)["at"] != F.get(held, i - 1)["at"]),
        )

        def share(i: Column) -> Column:
            near = F.slice(held, F.greatest(i - len(postings), F.lit(0)) + 1, F.least(i, F.lit(len(postings))))
            mine = F.filter(near, lambda x: x["at"] == F.get(held, i - 1)["at"])
            return F.aggregate(mine, F.lit(0.0), lambda sofar, x: sofar + x["idf"]) / F.lit(total)

        return F.transform(last, lambda i: F.struct(F.get(held, i - 1)["at"].alias("at"), share(i).alias("share")))

    # Bound as a lambda's variable, the sorted starts are evaluated once and not for every start.
    sums = F.flatten(F.transform(F.filter(F.array(starts), lambda held: F.size(held) > 0), summed))

    def verified(x: Column) -> Column:
        around = F.slice("_words", F.greatest(x["at"] - span, F.lit(0)) + 1, 3 * span)
        return (x["share"] >= least) & F.contains(
            F.concat(F.lit(" "), F.array_join(around, " "), F.lit(" ")), F.lit(f" {' '.join(key)} ")
        )

    return F.coalesce(F.array_max(F.transform(F.filter(sums, verified), lambda x: x["share"])), F.lit(0.0))


def scan(
    docs: DataFrame,
    templates=TEMPLATES,
    base=BASE,
    rare_words: int = RARE_WORDS,
    share: float = SHARE,
) -> DataFrame:
    """``docs`` without its text, and what its licence words say.

    Document frequencies of all notice words are counted over all of ``docs``
    and give their IDF. Each notice and each base phrase is indexed by its
    ``rare_words`` words of the highest IDF. A document's own words in that
    index are looked up with their positions; postings of one notice that agree
    on where the notice would start are intersected by summing their IDF. A
    notice is reported if at least ``share`` of its indexed IDF agrees on one
    start and its key phrase stands whole in the words around it. Base phrases
    are searched the same way, with every word verified; all their places count.

    Columns: n_words, n_base, first_word, last_word (null without a place),
    base_labels, labels (distinct, sorted, comma-joined; empty if none), score
    (largest agreed share of a reported notice, 1 with a base place, else 0).
    A null text has no words. Every document stays one row of its own: nothing
    is shuffled but counts of the notice words. Repeated rows repeat their
    result; an empty table gives no rows. The notices bound what is broadcast.
    """
    notices = [(label, text.split(" "), key.split(" ")) for label, text, key in templates]
    vocabulary = sorted({w for _, text, key in notices for w in text + key} | {w for p, _ in base for w in p.split(" ")})
    known = F.array(*[F.lit(w) for w in vocabulary])
    words = docs.select(words_of().alias("words"))
    frequent = (
        words.select(F.explode(F.array_intersect("words", known)).alias("word")).groupBy("word").count()
    )
    total = words.count()
    seen = {r["word"]: r["count"] for r in frequent.collect()}  # at most the notice words
    idf = {w: math.log((1.0 + total) / (1.0 + seen.get(w, 0))) + 1e-6 for w in vocabulary}

    def rarest(text: list[str]) -> list[tuple[str, int]]:
        first = {w: text.index(w) for w in text}
        return sorted(first.items(), key=lambda item: (-idf[item[0]], item[1]))[:rare_words]

    postings = []  # (word, offset, notice number, idf)
    for number, (_, text, _) in enumerate(notices):
        postings += [(w, at, number, idf[w]) for w, at in rarest(text)]
    phrase_words = [p.split(" ") for p, _ in base]
    anchors = [max(((idf[w], -i) for i, w in enumerate(p))) for p in phrase_words]
    anchors = [-i for _, i in anchors]
    looked_up = sorted({w for w, *_ in postings} | {p[i] for p, i in zip(phrase_words, anchors)})
    rare = F.array(*[F.lit(w) for w in looked_up])

    marked = packed(docs, "text").withColumn("_words", words_of())
    has_rare = F.arrays_overlap("_words", rare)
    hits = F.when(
        has_rare,
        F.filter(
            F.transform("_words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))),
            lambda h: F.array_contains(rare, h["word"]),
        ),
    ).otherwise(F.array().cast("array<struct<at:int,word:string>>"))
    marked = marked.withColumn("_hits", hits)

    def stands(phrase: list[str], at: Column) -> Column:
        return (at >= 0) & (
            F.slice("_words", F.greatest(at, F.lit(0)) + 1, len(phrase)) == F.array(*[F.lit(w) for w in phrase])
        )

    def places(phrase: list[str], anchor: int) -> Column:
        starts = F.transform(
            F.filter("_hits", lambda h: h["word"] == phrase[anchor]), lambda h: h["at"] - F.lit(anchor)
        )
        return F.filter(starts, lambda at: stands(phrase, at))

    base_columns = [f"_base{i}" for i in range(len(base))]
    marked = marked.withColumns({c: places(p, a) for c, p, a in zip(base_columns, phrase_words, anchors)})

    found = {}
    for number, (_, text, key) in enumerate(notices):
        mine = {w: (at, weight) for w, at, n, weight in postings if n == number}
        found[f"_notice{number}"] = _agreed_share(mine, text, key, share)
    marked = marked.withColumns(
        {n: F.when(F.size("_hits") > 0, c).otherwise(F.lit(0.0)) for n, c in found.items()}
    )
    spots = F.concat(*[F.col(c) for c in base_columns])
    base_labels = F.array_compact(
        F.array(*[F.when(F.size(c) > 0, F.lit(label)) for c, (_, label) in zip(base_columns, base)])
    )
    notice_labels = F.array_compact(
        F.array(*[F.when(F.col(f"_notice{i}") > 0, F.lit(label)) for i, (label, _, _) in enumerate(notices)])
    )
    score = F.greatest(*[F.col(n) for n in found], F.when(F.size(spots) > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    added = {
        "n_words": F.size("_words").cast("bigint"),
        "n_base": F.size(spots).cast("bigint"),
        "first_word": F.array_min(spots).cast("bigint"),
        "last_word": F.array_max(spots).cast("bigint"),
        "base_labels": F.array_join(F.array_sort(F.array_distinct(base_labels)), ","),
        "labels": F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, notice_labels))), ","),
        "score": F.least(score, F.lit(1.0)),
    }
    kept = [c for c in docs.columns if c != "text" and c not in added]
    return marked.select(*unpacked(kept, ()), *[value.alias(name) for name, value in added.items()])
