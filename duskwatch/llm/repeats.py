"""Long repeats of a symbol sequence (bytes or words) across all documents.

A window is ``window`` consecutive symbols of one document. Two equal windows hold
the same *anchor*: the gram of ``gram`` symbols with the smallest hash in the
window. Consecutive windows with one anchor are a *run*; a document is a chain of
runs, one per 100 or so symbols. Only what can decide a repeat is moved:

1. each partition cuts its documents into runs (one narrow row each);
2. runs whose anchor occurs once in the corpus hold no repeat and are dropped;
3. runs that are equal as a whole are repeats of each other;
4. what is left are different runs around one anchor, as at the ends of a copied
   passage. Their windows are compared by the caller's method, each distinct run
   once, however many documents hold it.

Windows repeated inside one document are found in its partition, and only the
first of them takes part in steps 2 to 4, so monotonous texts stay small.
Identity of runs and windows is a 128-bit hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskwatch.llm.common import handing_back, stored, text_bytes, unzip
from duskwatch.llm.symbols import Prefix, Rolling, white_table, word_bounds

RUNS = "_k1 bigint, _k2 bigint, _id bigint, kind int, h bigint, r1 bigint, r2 bigint, start int, n int"
_BINARY, _LONGS = T.BinaryType(), T.ArrayType(T.LongType())
LOCAL_ANY, LOCAL_LATER = 1, 2  # kinds of rows that are repeats inside one document


@dataclass(frozen=True)
class Shape:
    """What a window is made of."""

    words: bool
    window: int
    gram: int


class Sequences:
    """Symbol values of a text, and hashes of slices of them."""

    def __init__(self, shape: Shape):
        self.shape = shape
        self.one, self.two = Rolling(101), Rolling(202)
        self.white = white_table()

    def prefixes(self, raw: bytes) -> tuple[Prefix, Prefix]:
        data = np.frombuffer(raw, np.uint8)
        if not self.shape.words:
            return self.one.prefix(data), self.two.prefix(data)
        starts, ends = word_bounds(data, self.white)
        values = self.one.slices(self.one.prefix(data), starts, ends)
        other = self.two.slices(self.two.prefix(data), starts, ends)
        return self.one.prefix(values), self.two.prefix(other)

    def windows(self, prefixes: tuple[Prefix, Prefix]) -> tuple[np.ndarray, np.ndarray]:
        return (
            self.one.grams(prefixes[0], self.shape.window),
            self.two.grams(prefixes[1], self.shape.window),
        )

    def anchors(self, prefix: Prefix) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every gram; position of the leftmost smallest gram of every window."""
        grams = self.one.grams(prefix, self.shape.gram)
        width = self.shape.window - self.shape.gram + 1
        count = len(grams) - width + 1
        keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        blocks = -(-len(keys) // width)
        padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(keys)] = keys
        padded = padded.reshape(blocks, width)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
        return grams, (least & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def runs(self, raw: bytes) -> list[tuple[int, np.ndarray, ...]]:
        """Parts (kind, h, r1, r2, start, n) of one text."""
        window = self.shape.window
        if len(raw) < window:
            return []
        one, two = self.prefixes(raw)
        if one.symbols < window:
            return []
        grams, at = self.anchors(one)
        step = np.flatnonzero(at[1:] != at[:-1]) + 1
        starts = np.concatenate([[0], step])
        parts = []
        hashes = grams[at[starts]]
        if len(np.unique(hashes)) == len(hashes):
            ends = np.append(step, len(at))
        else:
            a, b = self.windows((one, two))
            order = np.lexsort((np.arange(len(a)), b, a))
            same = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
            later, again = np.zeros(len(a), bool), np.zeros(len(a), bool)
            later[order[1:][same]] = True
            again[order[:-1][same]] = True
            for kind, mask in ((LOCAL_ANY, later | again), (LOCAL_LATER, later)):
                s, e = intervals(mask)
                none = np.zeros(len(s), np.uint64)
                parts.append((kind, none, none, none, s, e - s))
            change = np.flatnonzero((at[1:] != at[:-1]) | (later[1:] != later[:-1])) + 1
            starts, ends = np.concatenate([[0], change]), np.append(change, len(at))
            first = ~later[starts]
            starts, ends = starts[first], ends[first]
            hashes = grams[at[starts]]
        stop = ends - 1 + window
        parts.append(
            (0, hashes, self.one.slices(one, starts, stop), self.two.slices(two, starts, stop), starts, ends - starts)
        )
        return parts


def intervals(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true stretches."""
    wide = np.zeros(len(mask) + 2, np.int8)
    wide[1:-1] = mask
    steps = np.diff(wide)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def _cut(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = Sequences(shape)
        for batch in batches:
            owner: list[np.ndarray] = []
            found: list[list[np.ndarray]] = [[] for _ in range(6)]
            for i, text in enumerate(batch.column(3)):
                for kind, *columns in sequences.runs(text.as_py()):
                    size = len(columns[0])
                    owner.append(np.full(size, i))
                    for held, values in zip(found, (np.full(size, kind), *columns)):
                        held.append(values)
            if not owner:
                continue
            who = pa.array(np.concatenate(owner))
            kind, h, r1, r2, start, n = (np.concatenate(c) for c in found)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i).take(who) for i in range(3)],
                    pa.array(kind.astype(np.int32)),
                    *[pa.array(c.view(np.int64)) for c in (h, r1, r2)],
                    *[pa.array(c.astype(np.int32)) for c in (start, n)],
                ],
                ["_k1", "_k2", "_id", "kind", "h", "r1", "r2", "start", "n"],
            )

    return run


def cut_into_runs(keyed: DataFrame, shape: Shape) -> DataFrame:
    """One row per run, and rows for the windows repeated inside one document."""
    narrow = keyed.select("_k1", "_k2", F.col("doc_id").cast("bigint").alias("_id"), text_bytes().alias("_text"))
    return narrow.mapInArrow(handing_back(_cut(shape)), RUNS)


def variants_of(runs: DataFrame) -> DataFrame:
    """Distinct runs around anchors that occur again: times, first place, runs of the anchor."""
    place = F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_k1", "_k2", "start")
    distinct = runs.groupBy("h", "r1", "r2", "n").agg(F.count("*").alias("times"), F.min(place).alias("first"))
    return distinct


def pieces(
    zipped: DataFrame, unlike: DataFrame, shape: Shape, cut: Callable, kind: str, carried: list[str]
) -> DataFrame:
    """``carried`` columns of ``unlike`` and ``piece``: symbols of runs, from the document that holds each first.

    ``cut(sequences, raw)`` is called once per document and returns a function of
    (start, n) giving the values of one run (bytes, or numpy longs).
    """
    at = [F.col("first.start").alias("_start"), F.col("n").alias("_n")]
    wanted = unlike.groupBy(F.col("first._k1").alias("_k1"), F.col("first._k2").alias("_k2")).agg(
        F.collect_list(F.struct(*carried, *at)).alias("wanted")
    )
    # Equal documents given several times hold the same symbols, and each may answer.
    joined = zipped.select("_k1", "_k2", "_zip").join(wanted, ["_k1", "_k2"]).select("wanted", "_zip")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences, open_text = Sequences(shape), unzip()
        for batch in batches:
            lists = batch.column(0)
            starts = lists.values.field("_start").to_numpy(zero_copy_only=False)
            counts = lists.values.field("_n").to_numpy(zero_copy_only=False)
            offsets = lists.offsets.to_pylist()
            values = []
            for i, text in enumerate(batch.column(1)):
                of_run = cut(sequences, open_text(text.as_py()))
                values += [of_run(starts[j], counts[j]) for j in range(offsets[i], offsets[i + 1])]
            if not values:
                continue
            if kind == "binary":
                piece = pa.array(values, pa.binary())
            else:
                ends = np.cumsum([0, *map(len, values)])
                piece = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values), pa.int64()))
            inner = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
            yield pa.RecordBatch.from_arrays([*[inner.field(c) for c in carried], piece], [*carried, "piece"])

    return joined.mapInArrow(run, unlike.select(*carried).schema.add("piece", _BINARY if kind == "binary" else _LONGS))


def repeated_spans(
    shape: Shape,
    compare: Callable[[DataFrame, DataFrame], DataFrame],
    keep_first: bool,
    keyed: DataFrame,
    zipped: DataFrame,
) -> DataFrame:
    """(_k1, _k2, spans): for every document with repeats, [start, end) symbols to remove.

    ``compare(zipped, unlike)`` decides step 4: for each distinct run around an
    anchor with several of them it gives the window offsets found elsewhere
    (``others``) and found earlier (``earlier``) as lists of (start, end).
    With ``keep_first`` the first of equal windows stays: order is by doc_id
    (null last), document key and position.
    """
    runs = stored(cut_into_runs(keyed, shape), "runs")
    single = runs.where("kind = 0")
    repeated = single.groupBy("h").count().where("count > 1").select("h")
    kept = stored(single.join(repeated, "h", "left_semi"), "repeated-runs")
    variants = stored(variants_of(kept), "variants")
    several = variants.groupBy("h").agg(F.count("*").alias("of_anchor")).where("of_anchor > 1")
    # Every distinct run around such an anchor, with its number of runs.
    unlike = variants.join(several, "h")
    decided = compare(zipped, unlike)
    verdict = (
        variants.join(decided, ["h", "r1", "r2", "n"], "left")
        .where("times > 1 OR others IS NOT NULL")
        .select("h", "r1", "r2", "n", "times", "first", "others", "earlier")
    )
    here = F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_k1", "_k2", "start")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("end")))
    if keep_first:
        at = F.when(here.eqNullSafe(F.col("first")), F.col("earlier")).otherwise(whole)
    else:
        at = F.when(F.col("times") > 1, whole).otherwise(F.col("others"))
    found = (
        kept.join(verdict, ["h", "r1", "r2", "n"])
        .select("_k1", "_k2", "start", F.explode(at).alias("w"))
        .select(
            "_k1",
            "_k2",
            (F.col("start") + F.col("w.start")).alias("start"),
            (F.col("start") + F.col("w.end") - 1 + shape.window).alias("end"),
        )
    )
    local = runs.where(F.col("kind") == (LOCAL_LATER if keep_first else LOCAL_ANY)).select(
        "_k1", "_k2", "start", (F.col("start") + F.col("n") - 1 + shape.window).alias("end")
    )
    return found.union(local).groupBy("_k1", "_k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def hashed_windows(pieces_of: DataFrame, shape: Shape, step: int = 16) -> DataFrame:
    """Others and earlier for runs of anchors too many to compare in one task.

    Equal windows hold their anchor at the same offset, so each run is cut into
    stretches of windows whose offsets fall into one range of ``step``. Stretches
    that are equal as a whole repeat each other, and the first of them stands for
    all in what follows. The windows of a stretch have a core in common; a stretch
    whose core no unlike stretch has holds no other repeat. Windows left are one
    row each, keyed by their hash; equal ones meet in a grouped minimum and maximum
    of their places, with map-side combining, so no anchor fills a task.
    """
    run_of = ["h", "r1", "r2", "n"]
    wide = pieces_of.select(*run_of, "first", "piece")

    def open_run(sequences: Sequences, piece: pa.Scalar):
        values = _values(piece)
        one, two = sequences.one.prefix(values), sequences.two.prefix(values)
        count = one.symbols + 1 - shape.window
        anchor = int(sequences.anchors(one)[1][0])
        return one, two, (anchor - np.arange(count)) // step, anchor

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = Sequences(shape)
        for batch in batches:
            who, found = [], [[] for _ in range(7)]
            for i, piece in enumerate(batch.column(5)):
                one, two, of_window, anchor = open_run(sequences, piece)
                edge = np.flatnonzero(of_window[1:] != of_window[:-1]) + 1
                starts, ends = np.concatenate([[0], edge]), np.append(edge, len(of_window))
                part = of_window[starts]
                core, after = np.maximum(anchor - part * step, 0), anchor - (part + 1) * step + 1 + shape.window
                stop = ends - 1 + shape.window
                who.append(np.full(len(part), i))
                for held, values in zip(
                    found,
                    (
                        part.astype(np.int32), starts.astype(np.int32), (ends - starts).astype(np.int32),
                        sequences.one.slices(one, core, after).view(np.int64),
                        sequences.two.slices(two, core, after).view(np.int64),
                        sequences.one.slices(one, starts, stop).view(np.int64),
                        sequences.two.slices(two, starts, stop).view(np.int64),
                    ),
                ):
                    held.append(values)
            if who:
                who = pa.array(np.concatenate(who))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).take(who) for i in range(5)], *[pa.array(np.concatenate(c)) for c in found]],
                    [*run_of, "first", "part", "start", "count", "c1", "c2", "s1", "s2"],
                )

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = Sequences(shape)
        for batch in batches:
            who, at, left, right = [], [], [], []
            for i, (piece, parts) in enumerate(zip(batch.column(5), batch.column(6))):
                one, two, of_window, _ = open_run(sequences, piece)
                mine = np.flatnonzero(np.isin(of_window, parts.values.to_numpy()))
                who.append(np.full(len(mine), i))
                at.append(mine.astype(np.int32))
                left.append(sequences.one.slices(one, mine, mine + shape.window).view(np.int64))
                right.append(sequences.two.slices(two, mine, mine + shape.window).view(np.int64))
            if who:
                who = pa.array(np.concatenate(who))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).take(who) for i in range(5)],
                     *[pa.array(np.concatenate(c)) for c in (at, left, right)]],
                    [*run_of, "first", "start", "e1", "e2"],
                )

    own = wide.drop("piece").schema
    longs = ["c1", "c2", "s1", "s2"]
    counts = [(n, "integer") for n in ("part", "start", "count")]
    # Stored, as both are read several times and each reading would cut all runs anew.
    stretches = stored(wide.mapInArrow(cut, _with(own, [*counts, *[(n, "long") for n in longs]])), "stretches")
    place = F.struct("first", "start")
    alike = stretches.groupBy("s1", "s2").agg(
        F.min(F.struct("first", "start", *run_of, "part", "c1", "c2")).alias("low"), F.max(place).alias("high")
    )
    low = F.struct("low.first", "low.start")
    whole = (
        stretches.join(alike.select("s1", "s2", low.alias("low"), "high").where("low != high"), ["s1", "s2"])
        # Rows equal in id and text are one place.
        .select(*run_of, "start", (F.col("start") + F.col("count")).alias("end"), (place != F.col("low")).alias("later"))
    )
    leaders = alike.select("low.*")
    shared = leaders.groupBy("c1", "c2").count().where("count > 1").drop("count")
    parts = leaders.join(shared, ["c1", "c2"], "left_semi").groupBy(*run_of).agg(F.collect_list("part").alias("parts"))
    chosen = wide.join(parts, run_of).select(*run_of, "first", "piece", "parts")
    rows = stored(chosen.mapInArrow(windows, _with(own, [("start", "integer"), ("e1", "long"), ("e2", "long")])), "windows")
    total = (
        rows.groupBy("e1", "e2").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low != high").drop("high")
    )
    single = rows.join(total, ["e1", "e2"]).select(
        *run_of, "start", (F.col("start") + 1).alias("end"), (place != F.col("low")).alias("later")
    )
    span = F.struct("start", "end")
    return whole.union(single).groupBy(*run_of).agg(
        F.collect_list(span).alias("others"), F.collect_list(F.when(F.col("later"), span)).alias("earlier")
    )


def _values(piece: pa.Scalar) -> np.ndarray:
    if isinstance(piece, pa.BinaryScalar):
        return np.frombuffer(piece.as_py(), np.uint8)
    return piece.values.to_numpy().view(np.uint64)


def _with(schema: T.StructType, more: list[tuple[str, str]]) -> T.StructType:
    wider = T.StructType(list(schema.fields))
    for name, kind in more:
        wider.add(name, kind)
    return wider
