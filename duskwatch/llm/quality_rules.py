"""Quality rules, and an isolation forest over their statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import freeze, text_bytes
from duskwatch.llm.symbols import Rolling, white_table, word_bounds

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
# Rows the forest is fitted on (expected), trees, rows of a tree, and the share of
# labelled good rows the calibrated threshold may give up.
FIT_ROWS = 8192
TREES = 128
TREE_ROWS = 256
GOOD_LOSS = 0.005
# Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_chars", "n_upper", "n_digits", "n_punct", "n_distinct", "n_next_same", "n_long_lines")
FEATURES = (
    "word_length", "symbol_rate", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punct_rate",
    "distinct_share", "next_same_share", "words_per_line",
)
# The forest splits on what the base rules leave open; repeats are theirs.
SPLIT_ON = ("word_length", "symbol_rate", "upper_share", "punct_rate", "distinct_share")
STEADY_WORDS = 60  # with so many words, half of a rate's distance from the median counts


def _class_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


class Statistics:
    """Rule statistics of one text from its bytes, without a loop over words."""

    def __init__(self):
        self.hash = Rolling(5)
        self.white = white_table()
        self.symbol = _class_table(SYMBOLS)
        self.upper = _class_table(bytes(range(65, 91)))
        self.digit = _class_table(bytes(range(48, 58)))
        self.punct = _class_table(b".,;:!?'\"()-")

    def of(self, raw: bytes) -> tuple[int, ...]:
        data = np.frombuffer(raw, np.uint8)
        starts, ends = word_bounds(data, self.white)
        n = len(starts)
        if not n:
            return (0,) * (len(COUNTS) + len(MORE))
        leads = (data & 0xC0) != 0x80  # bytes that begin a code point
        word_chars = int((leads & ~self.white[data]).sum())
        prefix = self.hash.prefix(data)
        words = self.hash.slices(prefix, starts, ends)
        breaks = np.flatnonzero(data == 10)
        line_starts = np.concatenate([[0], breaks + 1])
        line_ends = np.append(breaks, len(data))
        filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
        lines = self.hash.slices(prefix, line_starts[filled], line_ends[filled])
        repeated = 0
        if n >= WINDOW:
            grams = self.hash.grams(self.hash.prefix(words), WINDOW)
            _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
            twice = np.flatnonzero(counts[inverse] > 1)
            if len(twice):
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, twice, 1)
                np.add.at(edge, twice + WINDOW, -1)
                repeated = int((np.cumsum(edge)[:-1] > 0).sum())
        tally = np.bincount(data, minlength=256)
        return (
            n,
            word_chars,
            int(tally[self.symbol].sum()),
            len(lines) - len(np.unique(lines)),
            repeated,
            len(lines),
            int(leads.sum()),
            int(tally[self.upper].sum()),
            int(tally[self.digit].sum()),
            int(tally[self.punct].sum()),
            len(np.unique(words)),
            int((words[1:] == words[:-1]).sum()),
            int((line_ends - line_starts > 200).sum()),
        )


def with_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the statistics of every whole text; a null text has no words.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines
    with a word, equal to an earlier line), n_repeat_words (words in windows of
    eight words found twice or more in the text, the first included), and
    others the forest uses.
    """
    keep = list(keep)
    names = [*COUNTS, *MORE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        statistics = Statistics()
        for batch in batches:
            rows = [statistics.of(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            table = np.array(rows, np.int64).reshape(-1, len(names))
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*kept, *[pa.array(table[:, i]) for i in range(len(names))]], [*keep, *names]
            )

    narrow = docs.select(*keep, text_bytes().alias("_text"))
    schema = narrow.drop("_text").withColumns({n: F.lit(0).cast("bigint") for n in names}).schema
    return narrow.mapInArrow(run, schema)


def features(table: pd.DataFrame) -> np.ndarray:
    """Rates and shares of the statistics, in the order of FEATURES."""
    words = np.maximum(table["n_words"].to_numpy(float), 1)
    lines = np.maximum(table["n_lines"].to_numpy(float), 1)
    chars = np.maximum(table["n_chars"].to_numpy(float), 1)
    return np.column_stack(
        [
            np.log(table["word_chars"] / words + 1),
            table["n_symbols"] / words,
            table["n_dup_lines"] / lines,
            table["n_repeat_words"] / words,
            table["n_upper"] / chars,
            table["n_digits"] / chars,
            table["n_punct"] / words,
            table["n_distinct"] / words * np.log(words + 1) / np.log(400.0),
            table["n_next_same"] / words,
            np.log(words / lines + 1),
        ]
    ).astype(np.float64)


def forest_columns(table: pd.DataFrame, centre: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The columns the forest splits on and their medians; rates of short texts move to the median."""
    rows = features(table)[:, [FEATURES.index(n) for n in SPLIT_ON]]
    if centre is None:
        centre = np.median(rows, axis=0)
    words = table["n_words"].to_numpy(float)
    return centre + (rows - centre) * np.sqrt(words / (words + STEADY_WORDS))[:, None], centre


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    wide = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(wide - 1) + np.euler_gamma) - 2 * (wide - 1) / wide, np.where(n == 2, 1.0, 0.0))


def fit_forest(rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 3) -> dict[str, np.ndarray]:
    """Random splits as arrays (tree, node): feature (-1: leaf), cut, left child, path length at a leaf."""
    draw = np.random.default_rng(seed)
    size = min(tree_rows, len(rows))
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    nodes = 1 << (depth + 1)
    feature = np.full((trees, nodes), -1, np.int16)
    cut = np.zeros((trees, nodes))
    length = np.zeros((trees, nodes))
    for tree in range(trees):
        left = [(1, rows[draw.choice(len(rows), size, replace=False)], 0)]
        while left:
            node, part, level = left.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            open_to = np.flatnonzero(high > low)
            if level == depth or len(part) < 2 or not len(open_to):
                length[tree, node] = level + float(_average_path(len(part)))
                continue
            column = int(draw.choice(open_to))
            at = draw.uniform(low[column], high[column])
            feature[tree, node], cut[tree, node] = column, at
            below = part[:, column] < at
            left += [(2 * node, part[below], level + 1), (2 * node + 1, part[~below], level + 1)]
            if not below.any():  # a draw on the lowest value: an empty leaf
                left.pop(-2)
                length[tree, 2 * node] = level + 1
    return {"feature": feature, "cut": cut, "length": length, "size": np.array(size), "depth": np.array(depth)}


def forest_scores(forest: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Anomaly score in (0, 1) of every row: higher for shorter paths."""
    total = np.zeros(len(rows))
    every = np.arange(len(rows))
    for feature, cut, length in zip(forest["feature"], forest["cut"], forest["length"]):
        node = np.ones(len(rows), np.int64)
        for _ in range(int(forest["depth"])):
            column = feature[node]
            inner = column >= 0
            right = rows[every, np.where(inner, column, 0)] >= cut[node]
            node = np.where(inner, 2 * node + right, node)
        total += length[node]
    mean = total / len(forest["feature"])
    return 2.0 ** (-mean / max(float(_average_path(float(forest["size"]))), 1e-9))


def calibrated_threshold(bins: list[tuple[int, int, int]], loss: float = GOOD_LOSS, scale: int = 10_000) -> float | None:
    """The score above which rows are rejected, from (score bin, quality, rows).

    Of the thresholds that give up at most ``loss`` of the labelled good rows, the
    one with the best sum of hit rates; None without labelled rows of both kinds.
    """
    good, bad = np.zeros(scale + 2), np.zeros(scale + 2)
    for at, quality, rows in bins:
        (good if quality else bad)[at] += rows
    if not good.sum() or not bad.sum():
        return None
    good_above = np.cumsum(good[::-1])[::-1] / good.sum()
    bad_above = np.cumsum(bad[::-1])[::-1] / bad.sum()
    gain = np.where(good_above <= loss, bad_above - good_above, -1.0)
    best = float(gain.max())
    at = np.flatnonzero(gain == best)
    return float(at[len(at) // 2]) / scale


def judge(
    docs: DataFrame,
    labels: DataFrame,
    fit_rows: int = FIT_ROWS,
    trees: int = TREES,
    tree_rows: int = TREE_ROWS,
    loss: float = GOOD_LOSS,
) -> DataFrame:
    """Statistics, ``base_failed``, ``anomaly`` and ``kept`` of every document.

    ``base_failed``: fewer than 20 words, or more than 30 per cent of the words in
    repeated windows. The forest is fitted on about ``fit_rows`` of the documents
    that pass (drawn by a hash, so the bound holds at every size), every document
    is scored, and the threshold is calibrated on the scores of all labelled
    documents that pass: rows above it are not kept. Without labels of both kinds,
    or without documents to fit on, only the base rules decide. ``labels`` has
    doc_id and quality; null ids match nothing, and of repeated labels each counts.
    A null text fails; whole texts count, however long; repeated rows each get their
    row and equal ones the same verdict. An empty table gives no rows.
    """
    counted = freeze(
        with_statistics(docs).withColumn(
            "base_failed",
            (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        )
    )
    names = [*COUNTS, *MORE]
    passed = counted.where("NOT base_failed")
    total = passed.count()
    rate = min(1.0, fit_rows / total) if total else 0.0
    drawn = F.pmod(F.xxhash64(F.lit(23), "doc_id", *names), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)))
    sample = passed.where(drawn).select(*names).toPandas()
    if len(sample) < 2:
        return counted.withColumns({"anomaly": F.lit(None).cast("double"), "kept": ~F.col("base_failed")})
    sample = sample.sort_values(names, kind="stable")
    rows, centre = forest_columns(sample)
    forest = fit_forest(rows, trees, tree_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = forest_scores(forest, forest_columns(batch.select(names).to_pandas(), centre)[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, "anomaly"])

    schema = counted.withColumn("anomaly", F.lit(0.0)).schema
    scored = freeze(counted.mapInArrow(run, schema))
    known = labels.where("quality IS NOT NULL").select("doc_id", (F.col("quality") > 0).cast("int").alias("_good"))
    bins = (
        scored.where("NOT base_failed")
        .join(known, "doc_id")
        .groupBy(F.floor(F.col("anomaly") * 10_000).cast("int").alias("at"), "_good")
        .count()
        .collect()
    )
    threshold = calibrated_threshold([(r["at"], r["_good"], r["count"]) for r in bins], loss)
    above = F.lit(False) if threshold is None else F.col("anomaly") >= threshold
    return scored.withColumn("kept", ~F.col("base_failed") & ~above)
