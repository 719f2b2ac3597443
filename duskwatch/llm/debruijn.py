"""Exact removal of repeated word passages over a compacted De Bruijn graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.llm.common import packed, stored, unpacked, unzip, with_document_key, with_zipped_text
from duskwatch.llm.repeats import Sequences, Shape, pieces, repeated_spans
from duskwatch.llm.symbols import merged

WINDOW_WORDS = 35
GRAM_WORDS = 8


# Runs around one anchor whose edges are counted in one task; beyond, by all tasks.
RUNS_OF_ANCHOR = 128
EDGES_PER_COUNT = 1 << 16


def _edges(limit: int):
    """Edge rows (run, at, e1, e2, f): f is the edge that follows in the run.

    Equal windows have equal anchors, so edges of an anchor whose runs are all here
    that occur once among them occur once in the corpus, and are left out.
    """

    def decide(held: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(piece) // 2 for _, _, piece in held])
        run = np.repeat([number for number, _, _ in held], sizes)
        both = np.concatenate([piece for _, _, piece in held]).reshape(-1, 2)
        first = np.cumsum(sizes) - sizes
        at = np.arange(len(both)) - np.repeat(first, sizes)
        following = np.append(both[1:, 0], 0)
        last = np.append(at[1:] == 0, True)
        order = np.lexsort((both[:, 1], both[:, 0]))
        same = (both[order[1:]] == both[order[:-1]]).all(axis=1)
        keep = np.repeat([crowded for _, crowded, _ in held], sizes)
        keep[order[1:][same]] = True
        keep[order[:-1][same]] = True
        return pa.RecordBatch.from_arrays(
            [
                pa.array(run[keep]),
                pa.array(at[keep].astype(np.int32)),
                pa.array(both[keep, 0]),
                pa.array(both[keep, 1]),
                pa.array(following[keep], mask=last[keep]),
            ],
            ["run", "at", "e1", "e2", "f"],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        edges, anchor = 0, None
        for batch in batches:
            pieces_of = batch.column(3)
            for i, (h, run, count) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                if h != anchor and edges >= EDGES_PER_COUNT:
                    yield decide(held)
                    held, edges = [], 0
                anchor = h
                if held and held[-1][0] == run:
                    continue  # from a row equal in id and text
                piece = pieces_of[i].values.to_numpy()
                held.append((run, count > limit, piece))
                edges += len(piece) // 2
        if held:
            yield decide(held)

    return cut


def compare_words(shape: Shape, limit: int):
    """How runs around one anchor are compared: as paths of a De Bruijn graph.

    The k-mers (k = the window) of the distinct runs are the edges; an edge leads
    from its first k - 1 words to its last k - 1 words. Edges that occur once are
    dropped. Where every place of an edge is followed by one and the same edge,
    and that edge is always preceded by it, the node between them does not branch
    and both join one path. Degrees come from grouped minima and maxima and reach
    the places of the edges through joins. A path is reported where its source
    coordinates, counted anew for the whole path, show it at two places or more.
    """

    def cut(sequences: Sequences, raw: bytes):
        one, two = sequences.windows(sequences.prefixes(raw))
        both = np.column_stack([one, two]).view(np.int64)
        return lambda start, n: both[start : start + n].ravel()

    def compare(zipped: DataFrame, unlike: DataFrame) -> DataFrame:
        # Runs are numbered in the order of their first places.
        numbered = stored(
            unlike.repartitionByRange("first")
            .sortWithinPartitions("first")
            .withColumn("run", F.monotonically_increasing_id()),
            "numbered",
        )
        fetched = pieces(zipped, numbered, shape, cut, "longs", ["h", "run", "of_anchor"])
        spread = F.when(F.col("of_anchor") > limit, F.xxhash64("run")).otherwise(F.lit(0))
        edges = stored(
            fetched.withColumn("spread", spread)
            .repartition("h", "spread")
            .sortWithinPartitions("h", "run")
            .select("h", "run", "of_anchor", "piece")
            .mapInArrow(_edges(limit), "run bigint, at int, e1 bigint, e2 bigint, f bigint"),
            "edges",
        )
        out = (
            edges.groupBy("e1", "e2")
            .agg(
                F.count("*").alias("places"),
                F.min("run").alias("low"),
                ((F.min("f") == F.max("f")) & (F.count("f") == F.count("*"))).alias("one_out"),
            )
            .where("places > 1")
        )
        into = (
            edges.where("f IS NOT NULL")
            .groupBy(F.col("f").alias("e1"))
            .agg(F.count("*").alias("entered"), (F.min("e1") == F.max("e1")).alias("one_in"))
        )
        nodes = out.join(into, "e1", "left").select(
            "e1", "e2", "low", F.coalesce("one_out", F.lit(False)).alias("one_out"),
            F.coalesce(F.col("one_in") & (F.col("entered") == F.col("places")), F.lit(False)).alias("one_in"),
        )
        placed = edges.drop("f").join(nodes, ["e1", "e2"])
        along = Window.partitionBy("run").orderBy("at")
        follows = (F.lag("at").over(along) == F.col("at") - 1) & F.lag("one_out").over(along) & F.col("one_in")
        steps = placed.withColumn("begins", F.when(follows, 0).otherwise(1)).withColumn(
            "path", F.sum("begins").over(along)
        )
        paths = steps.groupBy("run", "path").agg(
            F.min("at").alias("start"),
            (F.max("at") + 1).alias("end"),
            F.min_by(F.struct("e1", "e2", "low"), "at").alias("head"),
        )
        paths = paths.withColumn("size", F.col("end") - F.col("start"))
        seen = paths.groupBy("head", "size").agg(F.count("*").alias("sources")).where("sources > 1").drop("sources")
        span = F.struct("start", "end")
        found = (
            paths.join(seen, ["head", "size"], "left_semi")
            .groupBy("run")
            .agg(
                F.collect_list(span).alias("others"),
                F.collect_list(F.when(F.col("run") != F.col("head.low"), span)).alias("earlier"),
            )
        )
        return numbered.join(found, "run").select("h", "r1", "r2", "n", "others", "earlier")

    return compare


def deduplicate(
    docs: DataFrame, window: int = WINDOW_WORDS, keep_first: bool = True, gram: int = GRAM_WORDS,
    limit: int = RUNS_OF_ANCHOR,
) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; n_words, n_removed and ``kept`` (bytes) added.

    A word is removed if a window of ``window`` words that covers it occurs earlier
    (``keep_first``), or anywhere else. Words are stretches without white space
    (0x20, 0x09 to 0x0D), compared unchanged; kept words are joined by one space.
    Texts without repeats keep their white space in ``text``; ``kept`` is always
    joined. Documents are ordered by doc_id (null last), then by a key of id and
    text; rows equal in both are one document given several times. A null text
    stays null and has no words; an empty table gives no rows. Input columns
    with the name of an added one are replaced. Windows are judged
    on the input, over whole texts and all documents.
    """
    shape = Shape(words=True, window=window, gram=min(gram, window))
    keyed = with_document_key(packed(docs, "doc_id", "text"))
    zipped = with_zipped_text(keyed)
    spans = repeated_spans(shape, compare_words(shape, limit), keep_first, keyed, zipped)
    names = ["doc_id", "_rest", "_null"]
    joined = zipped.join(spans, ["_k1", "_k2"], "left").select(*names, "_zip", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_text = unzip()
        for batch in batches:
            n = batch.num_columns
            texts, kept, counts = [], [], []
            for text, cuts in zip(batch.column(n - 2), batch.column(n - 1)):
                raw = open_text(text.as_py())
                words = raw.split()
                total = len(words)
                if cuts.is_valid:
                    pairs = cuts.values
                    starts, ends = merged(pairs.field("start").to_numpy(), pairs.field("end").to_numpy())
                    edges = [0, *np.column_stack([starts, ends]).ravel().tolist(), total]
                    words = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
                joined_words = b" ".join(words)
                texts.append(joined_words if cuts.is_valid else raw)
                kept.append(joined_words)
                counts.append((total, total - len(words)))
            table = np.array(counts, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: n - 2],
                    *[pa.array(c, pa.binary()) for c in (texts, kept)],
                    *[pa.array(table[:, i]) for i in range(2)],
                ],
                [*batch.schema.names[: n - 2], "_cut", "kept", "n_words", "n_removed"],
            )

    schema = joined.select(*names).schema
    for name, kind in (("_cut", "binary"), ("kept", "binary"), ("n_words", "long"), ("n_removed", "long")):
        schema = schema.add(name, kind)
    done = joined.mapInArrow(run, schema)
    text = F.when(~F.col("_null"), F.col("_cut").cast("string"))
    return done.withColumn("text", text).select(
        *unpacked(docs.columns, ("doc_id", "text"), ("n_words", "n_removed", "kept"))
    )
