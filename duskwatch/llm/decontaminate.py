"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import packed, stored, unpacked, with_document_key
from duskwatch.llm.licenses import words_of

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19
BLOCKS = 5
# Item shingles that may be sent to every task; beyond that they are joined by a shuffle.
BROADCAST_SEEDS = 500_000
# Keys of documents that may be sent to every task; beyond that their texts are shuffled.
BROADCAST_DOCUMENTS = 500_000
STRIDE = 4


def _shingles(words: Column, size: Column) -> Column:
    """Word shingles; repeats are numbered, so that sets of them compare as multisets."""
    last = F.size(words) - size
    plain = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, size), " "))
    numbered = F.transform(
        plain,
        lambda s, i: F.concat(
            s, F.lit("\n"), F.size(F.filter(F.slice(plain, 1, i), lambda other: other == s)).cast("string")
        ),
    )
    return F.when(F.size(F.array_distinct(plain)) == F.size(plain), plain).otherwise(numbered)


def _fingerprint(shingles: Column) -> Column:
    """64-bit SimHash: a bit is set if it is set in over half of the shingles, repeats counted."""
    hashes = F.transform(shingles, lambda s: F.xxhash64(F.element_at(F.split(s, "\n"), 1)))
    bits = [
        F.when(
            2 * F.size(F.filter(hashes, lambda h: F.shiftright(h, bit).bitwiseAND(F.lit(1)) == 1)) > F.size(hashes),
            F.lit(1 << bit if bit < 63 else -(1 << 63)),
        ).otherwise(F.lit(0))
        for bit in range(64)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _blocks(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of even blocks of 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _block(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _flips(width: int, most: int) -> list[int]:
    """All values of ``width`` bits with at most ``most`` ones."""
    return [sum(1 << i for i in ones) for n in range(most + 1) for ones in combinations(range(width), n)]


def items_of(benchmark: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, words, length, size, shingles, fp) of benchmark items that have words."""
    words = benchmark.select("item_id", words_of().alias("words")).where(F.size("words") > 0)
    sized = words.withColumns(
        {"length": F.size("words"), "size": F.least(F.size("words"), F.lit(shingle))}
    )
    return sized.withColumn("shingles", _shingles(F.col("words"), F.col("size"))).withColumn(
        "fp", _fingerprint(F.col("shingles"))
    )


def _starts(words: DataFrame, seeds: DataFrame, strides: dict[int, int], few: bool, miss: float) -> DataFrame:
    """(_k1, _k2, length, size, starts): starts of windows with enough item shingles at every stride-th place.

    ``words`` has _k1, _k2, words. A window of n shingles that may miss floor(n * miss)
    of them holds at least floor(n / stride) of the places looked at, so at least
    the difference, ``least``, are hits: it starts not after some hit and ends not
    before the ``least``-th hit from there. No window with that many is left out.
    """
    hits = None
    for size, stride in sorted(strides.items()):  # at most ``shingle`` kinds
        places = F.sequence(F.lit(0), F.size("words") - size, F.lit(stride))
        looked = words.where(F.size("words") >= size).select(
            "_k1",
            "_k2",
            F.size("words").alias("n_words"),
            F.posexplode(
                F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice("words", i + 1, size), " ")))
            ).alias("nth", "seed"),
        )
        mine = seeds.where(F.col("size") == size)
        found = looked.join(F.broadcast(mine) if few else mine, "seed").select(
            "_k1", "_k2", "n_words", "length", "size", F.lit(stride).alias("stride"), (F.col("nth") * stride).alias("place")
        )
        hits = found if hits is None else hits.union(found)
    # A text shorter than the item is one window.
    n = F.least(F.col("length"), F.col("n_words")) - F.col("size") + 1
    least = F.floor(n / F.col("stride")) - F.floor(n * F.lit(miss) + F.lit(1e-9))
    spans = (
        hits.groupBy("_k1", "_k2", "n_words", "length", "size", "stride")
        .agg(F.sort_array(F.collect_set("place")).alias("places"))
        .withColumns({"n": n, "least": F.greatest(least, F.lit(1)).cast("int")})
        .where(F.size("places") >= F.col("least"))
        .withColumn("latest", F.greatest(F.col("n_words") - F.col("length"), F.lit(0)))
    )

    def of_hit(i: Column) -> Column:
        low = F.greatest(F.get("places", i + F.col("least") - 1) - F.col("n") + 1, F.lit(0))
        high = F.least(F.get("places", i), F.col("latest"))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    starts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size("places") - F.col("least")), of_hit)))
    return spans.select("_k1", "_k2", "length", "size", starts.alias("starts")).where(F.size("starts") > 0)


def _texts_of(keyed: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose _k1, _k2 are in ``chosen``, and perhaps a few others.

    Texts stay where they are read while the keys are few enough to be sent to
    every task: _k1 alone, which lets a row of an equal _k1 through. With more of
    them texts are shuffled, as they are and not sorted.
    """
    if chosen.limit(BROADCAST_DOCUMENTS + 1).count() <= BROADCAST_DOCUMENTS:
        return keyed.join(F.broadcast(chosen.select("_k1")), "_k1", "left_semi")
    return keyed.join(chosen.hint("shuffle_hash"), ["_k1", "_k2"], "left_semi")


def candidate_windows(keyed: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """(_k1, _k2, doc_id, length, size, at, shingles): item-sized windows that can reach ``similarity``.

    A window of that similarity shares all but a ninth of its shingles (0.8) with
    the item, in whatever order they stand. Every fourth shingle of all documents
    (every one where items have fewer than four) tells which documents can have
    such a window of a length; in those every shingle is looked at, and each start
    whose window has few enough foreign shingles is a window. Hits are counted per
    length over all items, which can only add windows. None of the similarity is lost.
    """
    miss = (1 - similarity) / (1 + similarity)  # share of its shingles a window may miss
    seeds = stored(
        items.select("length", "size", F.explode("shingles").alias("shingle"))
        .select("length", "size", F.xxhash64(F.element_at(F.split("shingle", "\n"), 1)).alias("seed"))
        .distinct(),
        "seeds",
    )
    kinds = seeds.groupBy("size").agg(F.min(F.col("length") - F.col("size") + 1).alias("least")).collect()
    few = seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS
    names = ["_k1", "_k2", "doc_id", "length", "size", "at", "shingles"]
    if not kinds:
        return keyed.where("false").selectExpr(
            "_k1", "_k2", "doc_id", "0 AS length", "0 AS size", "0 AS at", "CAST(array() AS array<string>) AS shingles"
        )
    # Every ``stride``-th place must leave more places than a window may miss.
    strides = {
        r["size"]: STRIDE if r["least"] >= STRIDE and miss < 1 / (2 * STRIDE) else 1 for r in kinds
    }
    words = keyed.select("_k1", "_k2", words_of().alias("words"))
    chosen = stored(_starts(words, seeds, strides, few, miss).select("_k1", "_k2").distinct(), "chosen")
    texts = stored(
        _texts_of(keyed, chosen).select("_k1", "_k2", "doc_id", words_of().alias("words")), "texts"
    )
    spots = _starts(texts.select("_k1", "_k2", "words"), seeds, dict.fromkeys(strides, 1), few, miss)
    # Repeated rows are one document, or their windows would meet each other in every join.
    once = texts.groupBy("_k1", "_k2").agg(F.first("doc_id").alias("doc_id"), F.first("words").alias("words"))
    return (
        once.join(spots, ["_k1", "_k2"])
        .select("_k1", "_k2", "doc_id", "words", "length", "size", F.explode("starts").alias("at"))
        .withColumn("shingles", _shingles(F.slice("words", F.col("at") + 1, F.col("length")), F.col("size")))
        .select(*names)
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    blocks: int = BLOCKS,
) -> DataFrame:
    """(_k1, _k2, doc_id, item_id, similarity, distance, first_word, n_words): a row per document and item found.

    Words are lower-cased (A-Z) stretches of letters, digits and non-ASCII
    characters. A window of as many words as the item (the whole text if that is
    shorter) is a match if its SimHash over word shingles differs in at most
    ``radius`` bits from the item's and the weighted Jaccard similarity of their
    shingles (weights: how often each occurs) is at least ``similarity``. Items of
    fewer than ``shingle`` words are one shingle. The best window is reported, by
    similarity, distance, then place.

    Fingerprints are cut into ``blocks``; two of them within ``radius`` bits have a
    block that differs in at most radius // blocks bits. The index holds every
    value so near to each item's block and windows meet it by an equi-join, so none
    within the radius is missed. Null and empty texts and items match nothing;
    empty tables give no rows; repeated rows give their result once.
    """
    keyed = with_document_key(docs.select("doc_id", "text"))
    items = stored(items_of(benchmark, shingle), "items")
    windows = candidate_windows(keyed, items, similarity).withColumn("fp", _fingerprint(F.col("shingles")))
    windows = stored(windows, "windows")
    parts = _blocks(blocks)
    near = radius // blocks
    index = reduce(
        DataFrame.union,
        [
            items.select(
                "item_id", "length", F.col("fp").alias("item_fp"), F.lit(b).alias("block"),
                F.explode(F.lit(_flips(width, near))).alias("flip"), _block(F.col("fp"), shift, width).alias("own"),
            ).select("item_id", "length", "item_fp", "block", F.col("own").bitwiseXOR(F.col("flip")).alias("value"))
            for b, (shift, width) in enumerate(parts)
        ],
    )
    probes = windows.select(
        "_k1", "_k2", "doc_id", "length", "at", "fp",
        F.posexplode(F.array(*[_block(F.col("fp"), shift, width) for shift, width in parts])).alias("block", "value"),
    )
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first_block = reduce(
        lambda rest, item: F.when(F.bit_count(_block(apart, *item[1])) <= near, F.lit(item[0])).otherwise(rest),
        reversed(list(enumerate(parts))),
        F.lit(-1),
    )
    within = (
        probes.join(index, ["length", "block", "value"])
        .withColumn("distance", F.bit_count(apart))
        .where((F.col("distance") <= radius) & (F.col("block") == first_block))  # each pair once
        .select("_k1", "_k2", "length", "at", "item_id", "item_fp", "distance")
    )
    pairs = within.join(windows, ["_k1", "_k2", "length", "at"]).join(
        items.select("item_id", F.col("fp").alias("item_fp"), "length", F.col("shingles").alias("item_shingles")),
        ["item_id", "item_fp", "length"],
    )
    shared = F.size(F.array_intersect("shingles", "item_shingles"))
    alike = shared / (F.size("shingles") + F.size("item_shingles") - shared)
    best = F.struct("similarity", (-F.col("distance")).alias("nearness"), (-F.col("at")).alias("earliness"), "length")
    return (
        pairs.withColumn("similarity", alike)
        .where(F.col("similarity") >= similarity)
        .groupBy("_k1", "_k2", "doc_id", "item_id")
        .agg(F.max(best).alias("best"))
        .select(
            "_k1", "_k2", "doc_id", "item_id", "best.similarity",
            (-F.col("best.nearness")).cast("int").alias("distance"),
            (-F.col("best.earliness")).cast("bigint").alias("first_word"),
            F.col("best.length").cast("bigint").alias("n_words"),
        )
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    found = contaminated(docs, benchmark, **parameters).select("_k1", "_k2").distinct()
    keyed = with_document_key(packed(docs, "doc_id", "text"))
    return keyed.join(found, ["_k1", "_k2"], "left_anti").select(*unpacked(docs.columns, ("doc_id", "text")))
