"""Exact substring de-duplication by longest-previous-factor arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import packed, stored, unpacked, unzip, with_document_key, with_zipped_text
from duskwatch.llm.repeats import Shape, hashed_windows, intervals, pieces, repeated_spans
from duskwatch.llm.symbols import merged

LEAST_BYTES = 400
GRAM = 128
# Runs around one anchor that are compared in one suffix array; anchors with more
# runs compare their windows by hash, spread over all tasks.
RUNS_OF_ANCHOR = 128
SUFFIXES_PER_ARRAY = 1 << 15

_SPANS = "array<struct<start:int,end:int>>"


def longest_previous_factors(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """LPF of every position: its longest match with an earlier position.

    ``order`` lists positions in suffix order, ``common[i]`` is the common prefix of
    ``order[i - 1]`` and ``order[i]``. A stack yields for every position the nearest
    smaller positions before and after it in suffix order; the longer of the two
    common prefixes is the factor (Crochemore and Ilie, 2008).
    """
    lpf = np.zeros(len(order), np.int64)
    positions = [*order.tolist(), -1]
    lengths = [*common.tolist(), 0]
    lengths[0] = 0
    stack: list[tuple[int, int]] = []
    for position, length in zip(positions, lengths):
        while stack:
            top, held = stack[-1]
            if position < top:  # the next smaller position; the previous one is below in the stack
                lpf[top] = max(held, length)
                length = min(held, length)
            elif length <= held:  # the previous smaller position matches longer than any later one
                lpf[top] = held
            else:
                break
            stack.pop()
        stack.append((position, length))
    return lpf


def longest_next_factors(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """LNF of every position: its longest match with a later position.

    Counted from the end, later positions are earlier ones, and the order of the
    suffixes is what it was.
    """
    return longest_previous_factors(len(order) - 1 - order, common)[::-1]


def window_matches(
    data: np.ndarray, starts: np.ndarray, least: int, keep_first: bool
) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes at ``starts`` (in order of first appearance): found elsewhere, found earlier.

    Suffixes are sorted by their first ``least`` bytes, which is all a match of
    that length depends on. With ``keep_first`` only what is earlier is looked for.
    """
    rows = np.lib.stride_tricks.sliding_window_view(data, least)[starts]
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{least}").ravel(), kind="stable")
    ranked = rows[order]
    unlike = ranked[1:] != ranked[:-1]
    common = np.zeros(len(order), np.int64)
    common[1:] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), least)
    earlier = longest_previous_factors(order, common) >= least
    if keep_first:
        return earlier, earlier
    return earlier | (longest_next_factors(order, common) >= least), earlier


def _arrays(least: int, keep_first: bool):
    """Suffix arrays over whole anchors, rows sorted by anchor and first place."""

    def decide(rows: list[tuple]) -> pa.RecordBatch:
        data, starts, sizes = [], [], []
        at = 0
        for _, _, _, n, piece in rows:
            data.append(piece)
            starts.append(np.arange(at, at + n))
            sizes.append(n)
            at += len(piece)
        other, earlier = window_matches(np.frombuffer(b"".join(data), np.uint8), np.concatenate(starts), least, keep_first)
        out, a = [], 0
        for (h, r1, r2, n, _), size in zip(rows, sizes):
            if other[a : a + size].any():
                out.append((h, r1, r2, n, _lists(other[a : a + size]), _lists(earlier[a : a + size])))
            a += size
        columns = list(zip(*out)) or [[]] * 6
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), span, span)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["h", "r1", "r2", "n", "others", "earlier"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        suffixes, anchor = 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if row[0] != anchor and suffixes >= SUFFIXES_PER_ARRAY:
                    yield decide(held)
                    held, suffixes = [], 0
                anchor = row[0]
                if held and held[-1][:4] == row[:4]:
                    continue  # from a row equal in id and text
                held.append(row)
                suffixes += row[3]
        if held:
            yield decide(held)

    return run


def _lists(mask: np.ndarray) -> list[dict[str, int]]:
    starts, ends = intervals(mask)
    return [{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist())]


def compare_bytes(shape: Shape, limit: int, keep_first: bool):
    """How runs around one anchor are compared: in suffix order, or by hash beyond ``limit`` of them."""

    def cut(_, raw: bytes):
        return lambda start, n: raw[start : start + n - 1 + shape.window]

    def compare(zipped: DataFrame, unlike: DataFrame) -> DataFrame:
        carried = ["h", "r1", "r2", "n", "of_anchor", "first"]
        fetched = stored(pieces(zipped, unlike, shape, cut, "binary", carried), "pieces")
        few = (
            fetched.where(F.col("of_anchor") <= limit)
            .select("h", "r1", "r2", "n", "piece", "first")
            .repartition("h")
            .sortWithinPartitions("h", "first")
            .select("h", "r1", "r2", "n", "piece")
        )
        in_order = few.mapInArrow(
            _arrays(shape.window, keep_first), f"h bigint, r1 bigint, r2 bigint, n int, others {_SPANS}, earlier {_SPANS}"
        )
        return in_order.union(hashed_windows(fetched.where(F.col("of_anchor") > limit), shape))

    return compare


def deduplicate(
    docs: DataFrame,
    least: int = LEAST_BYTES,
    keep_first: bool = True,
    gram: int = GRAM,
    limit: int = RUNS_OF_ANCHOR,
) -> DataFrame:
    """``docs`` with repeats cut out of ``text``; n_bytes, n_removed, n_spans and ``kept`` (bytes) added.

    A byte is removed if a string of ``least`` bytes that covers it starts earlier
    (``keep_first``), or anywhere else. Documents are ordered by doc_id (null
    last), then by a key of id and text. Rows equal in id and text are one
    document given several times: with ``keep_first`` they keep the same bytes.
    Texts are UTF-8 bytes, so a cut may fall inside a code point: ``text`` drops
    the broken bytes at the cut, ``kept`` has every byte. A null text stays null
    and counts as empty; texts under ``least`` bytes stay; an empty table gives
    no rows. Input columns with the name of an added one are replaced. Strings are judged on the input, whole texts, all documents.
    """
    shape = Shape(words=False, window=least, gram=min(gram, least))
    keyed = with_document_key(packed(docs, "doc_id", "text"))
    zipped = with_zipped_text(keyed)
    spans = repeated_spans(shape, compare_bytes(shape, limit, keep_first), keep_first, keyed, zipped)
    names = ["doc_id", "_rest", "_null"]
    joined = zipped.join(spans, ["_k1", "_k2"], "left").select(*names, "_zip", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_text = unzip()
        for batch in batches:
            n = batch.num_columns
            kept, counts = [], []
            for text, cuts in zip(batch.column(n - 2), batch.column(n - 1)):
                raw = open_text(text.as_py())
                if not cuts.is_valid:
                    kept.append(raw)
                    counts.append((len(raw), 0, 0))
                    continue
                pairs = cuts.values
                starts, ends = merged(pairs.field("start").to_numpy(), pairs.field("end").to_numpy())
                edges = [0, *np.column_stack([starts, ends]).ravel().tolist(), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                counts.append((len(raw), int((ends - starts).sum()), len(starts)))
            table = np.array(counts, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: n - 2], pa.array(kept, pa.binary()), *[pa.array(table[:, i]) for i in range(3)]],
                [*batch.schema.names[: n - 2], "kept", "n_bytes", "n_removed", "n_spans"],
            )

    schema = joined.select(*names).schema
    for name, kind in (("kept", "binary"), ("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long")):
        schema = schema.add(name, kind)
    done = joined.mapInArrow(run, schema)
    text = F.when(~F.col("_null"), _utf8("kept"))
    return done.withColumn("text", text).select(
        *unpacked(docs.columns, ("doc_id", "text"), ("n_bytes", "n_removed", "n_spans", "kept"))
    )


def _utf8(column: str):
    """Bytes as a text without the broken code points at cuts; replacement characters of the text itself stay."""
    text, lost, mark = F.col(column).cast("string"), F.lit("\ufffd"), F.lit("\ue000")
    own, other = F.lit("\ue000a"), F.lit("\ue000b")  # what stands for mark and lost while broken bytes become lost
    held = F.make_valid_utf8(F.replace(F.replace(text, mark, own), lost, other))
    mended = F.replace(F.replace(F.replace(held, lost, F.lit("")), other, lost), own, mark)
    return F.when(F.is_valid_utf8(text), text).otherwise(mended)
