"""Document quality by co-training a text view and a page-metadata view."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import packed, stored, text_bytes, unpacked
from duskwatch.llm.quality_rules import COUNTS, MORE, Statistics, calibrated_threshold, features

# Labelled documents (expected, half of each kind) drawn for fitting; documents drawn
# for fitting from those a view hands over as one kind in a round; rounds of exchange;
# the share of the pool a view may label more each round; how sure it must be.
FIT_ROWS = 16_000
HANDED_ROWS = 2_000
ROUNDS = 4
PER_ROUND = 0.1
CONFIDENCE = 0.97
# Share of the held-out good documents the decision threshold may give up.
GOOD_LOSS = 0.005
NAMED = 64  # hashed columns for each of language and source
META = ("lang", "source", "n_chars")
HASHES = 1 << 30
STEPS = 100  # bins per unit of a logit
SCALE = 10_000  # bins of a probability


def text_view(raws: Sequence[bytes]) -> np.ndarray:
    """What the text says: byte frequencies, the statistics of its words, its length and layout."""
    statistics = Statistics()
    table = pd.DataFrame([statistics.of(r) for r in raws], columns=[*COUNTS, *MORE])
    rates = features(table) if len(table) else np.zeros((0, 10))
    shares = np.zeros((len(raws), 129))
    layout = np.zeros((len(raws), 5))
    for i, raw in enumerate(raws):
        tally = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        shares[i, :128], shares[i, 128] = tally[:128], tally[128:].sum()
        size, lines = len(raw), raw.count(b"\n") + 1
        layout[i] = (
            np.log1p(size), np.log1p(lines), np.log1p(size / lines), raw.count(b" ") / max(size, 1), raw.count(b"\n\n") / lines,
        )
    shares = np.sqrt(shares / np.maximum(shares.sum(axis=1, keepdims=True), 1))
    return np.column_stack([rates, shares, layout]).astype(np.float32).astype(float)


def metadata_view(lang: Sequence, source: Sequence, n_chars: Sequence) -> np.ndarray:
    """What is known of the page without its text: origin, language and stated length."""
    out = np.zeros((len(lang), 2 * NAMED + 4))
    for i in range(len(lang)):
        for j, value in enumerate((lang[i], source[i])):
            if value is not None and value == value:
                out[i, j * NAMED + crc32(str(value).encode()) % NAMED] = 1.0
            else:
                out[i, 2 * NAMED + j] = 1.0
        chars = n_chars[i]
        stated = float(chars) if chars is not None and chars == chars else -1.0
        out[i, 2 * NAMED + 2 :] = np.log1p(max(stated, 0.0)), stated < 0
    return out.astype(np.float32).astype(float)


@dataclass
class Logistic:
    """Ridge logistic regression on standardised columns, by Newton steps, with Platt scaling."""

    ridge: float = 1.0
    slope: float = 1.0
    shift: float = 0.0

    def fit(self, rows: np.ndarray, good: np.ndarray, times: np.ndarray) -> Logistic:
        """``times``: how many documents a row stands for."""
        self.mean = np.average(rows, axis=0, weights=times)
        self.scale = np.sqrt(np.average((rows - self.mean) ** 2, axis=0, weights=times)) + 1e-6
        x = np.column_stack([np.ones(len(rows)), (rows - self.mean) / self.scale])
        weight = np.zeros(x.shape[1])
        penalty = np.full(x.shape[1], self.ridge)
        penalty[0] = 1e-6
        for _ in range(30):
            p = _sigmoid(x @ weight)
            slope = x.T @ (times * (good - p)) - penalty * weight
            curve = (x * (times * (p * (1 - p) + 1e-9))[:, None]).T @ x + np.diag(penalty)
            step = np.linalg.solve(curve, slope)
            weight += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        self.weight = weight
        return self

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(((rows - self.mean) / self.scale), -20, 20) @ self.weight[1:] + self.weight[0]

    def calibrate(self, rows: np.ndarray, good: np.ndarray, times: np.ndarray) -> Logistic:
        """Fit slope and shift of the raw score on rows not used for fitting."""
        z = self.raw(rows)
        spread = float(z.std()) + 1e-9
        inner = Logistic(ridge=1.0).fit((z / spread)[:, None], good, times)
        slope = inner.weight[1] / inner.scale[0] / spread
        self.shift = float(inner.weight[0] - inner.weight[1] * inner.mean[0] / inner.scale[0])
        self.slope = float(slope)
        return self

    def logit(self, rows: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(rows) + self.shift


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class CoTrained:
    """Both views, the weights that combine their calibrated logits, and the threshold in bins of 1 - p_good."""

    text: Logistic
    meta: Logistic
    joint: Logistic | None = None
    threshold: int = SCALE + 1
    exchanged: int = 0

    def logits(self, views: np.ndarray) -> np.ndarray:
        """(rows, 2): calibrated logit of good by text and by metadata."""
        width = len(self.text.weight) - 1
        return np.column_stack([self.text.logit(views[:, :width]), self.meta.logit(views[:, width:])])

    def scores(self, views: np.ndarray) -> np.ndarray:
        """(rows, 3): probability of good by text, by metadata, and combined."""
        each = self.logits(views)
        return np.column_stack([_sigmoid(each), _sigmoid(self.joint.logit(each))])


@dataclass
class Rows:
    """Views of drawn rows, whether each is good, and how many documents each stands for."""

    views: np.ndarray
    good: np.ndarray
    times: np.ndarray

    def part(self, chosen: np.ndarray) -> Rows:
        return Rows(self.views[chosen], self.good[chosen], self.times[chosen])


def _matrix(views: Sequence[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(views), np.float32).reshape(len(views), -1).astype(float)


def _drawn(rows: DataFrame, good: str = "_good") -> pd.DataFrame:
    """Drawn rows, equal ones once with their number, in an order that does not depend on tasks."""
    found = rows.groupBy("_at", good, "_view").agg(F.count("*").alias("_n")).toPandas()
    found["_view"] = found["_view"].map(bytes)
    return found.sort_values(["_at", good, "_view"], kind="stable").reset_index(drop=True)


def view_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Write (_at, _view, _good) of every document: a hash of id and text, both views, label 0, 1 or -1 (none).

    The views, not the texts, are joined with the labels. Labels of null quality
    or null id are none; of several labels of an id one good label makes it good.
    """
    known = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max(F.expr("quality > 0")).cast("int").alias("_good"))
    key = F.pmod(F.xxhash64(F.lit(31), "doc_id", "text"), F.lit(HASHES)).cast("int")

    @F.pandas_udf("binary")
    def view(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.Series:
        return pd.Series([row.tobytes() for row in _views(text, lang, source, n_chars).astype(np.float32)])

    rows = docs.select("doc_id", key.alias("_at"), view(*_inputs(docs)).alias("_view")).join(known, "doc_id", "left")
    return stored(rows.select("_at", "_view", F.coalesce("_good", F.lit(-1)).alias("_good")), "cotraining-views")


def _sure_bins(pool: DataFrame, model: CoTrained, least: int) -> np.ndarray:
    """(2 views, bins): documents of the pool per bin of the logit, for bins at least ``least`` from zero."""
    most = 40 * STEPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2 * most + 1), np.int64)
        for batch in batches:
            at = _logit_bins(model, batch.column(0).to_pylist()) + most
            for v in (0, 1):
                total[v] += np.bincount(at[:, v], minlength=2 * most + 1)
        total[:, most - least + 1 : most + least] = 0
        v, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(at), pa.array(total[v, at])], ["v", "at", "n"])

    out = np.zeros((2, 2 * most + 1), np.int64)
    counted = pool.select("_view").mapInArrow(run, "v bigint, at bigint, n bigint").groupBy("v", "at").agg(F.sum("n").alias("n"))
    for row in counted.collect():
        out[row["v"], row["at"]] = row["n"]
    return out


def _logit_bins(model: CoTrained, views: Sequence[bytes]) -> np.ndarray:
    """Whole steps of the logits towards zero, so that both signs are cut alike."""
    if not views:
        return np.zeros((0, 2), np.int64)
    return np.clip(np.trunc(model.logits(_matrix(views)) * STEPS), -40 * STEPS, 40 * STEPS).astype(np.int64)


def _cut(counts: np.ndarray, least: int, most: float) -> tuple[int, int]:
    """From bins in falling sureness, first to least: the last one within ``most`` documents, and their number.

    The first bin that holds any is always taken: equally sure documents are not told apart.
    """
    total = np.cumsum(counts)
    if not len(total) or not total[-1]:
        return least, 0
    first = int(np.flatnonzero(total)[0])
    last = max(first, int(np.searchsorted(total, most, side="right")) - 1)
    return 40 * STEPS - last, int(total[last])


def _handed(pool: DataFrame, model: CoTrained, sizes: dict[int, int], most: float, confidence: float, rows: int):
    """Pseudo-labels of one round: for each taker, rows drawn from all documents the other view is surest of."""
    least = int(np.ceil(np.log(confidence / (1 - confidence)) * STEPS))
    bins = _sure_bins(pool, model, least)
    whole, middle = sum(sizes.values()), 40 * STEPS
    cuts, rates, handed = np.zeros((2, 2), np.int64), np.zeros((2, 2)), 0
    for giver in (0, 1):
        for kind in (0, 1):
            falling = bins[giver][middle + least :][::-1] if kind else bins[giver][: middle - least + 1]
            cuts[giver, kind], n = _cut(falling, least, most * sizes[kind] / whole)
            rates[giver, kind] = min(1.0, rows / n) if n else 0.0
            handed += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views, keys = batch.column(0), batch.column(1).to_numpy()
            at = _logit_bins(model, views.to_pylist())
            for giver in (0, 1):
                for kind in (0, 1):
                    sure = at[:, giver] if kind else -at[:, giver]
                    chosen = np.flatnonzero((sure >= cuts[giver, kind]) & (keys < rates[giver, kind] * HASHES))
                    yield pa.RecordBatch.from_arrays(
                        [views.take(pa.array(chosen)), pa.array(keys[chosen]), pa.array(np.full(len(chosen), 2 * giver + kind, np.int32))],
                        ["_view", "_at", "_mark"],
                    )

    found = _drawn(pool.select("_view", "_at").mapInArrow(run, "_view binary, _at int, _mark int"), "_mark")
    given = []
    for giver in (0, 1):
        mine = found[found["_mark"] // 2 == giver]
        kinds = (mine["_mark"] % 2).to_numpy()
        given.append((mine["_view"].tolist(), kinds.astype(float), mine["_n"].to_numpy() / rates[giver][kinds]))
    return given[::-1], handed  # what view 1 gives, view 0 takes


def co_train(
    table: DataFrame,
    fit_rows: int = FIT_ROWS,
    handed_rows: int = HANDED_ROWS,
    rounds: int = ROUNDS,
    per_round: float = PER_ROUND,
    confidence: float = CONFIDENCE,
    loss: float = GOOD_LOSS,
) -> CoTrained | None:
    """Fit on the rows of ``view_table``. None without two labelled documents of each kind.

    About ``fit_rows`` labelled rows, half of each kind, are drawn by their hash; a
    third of each kind is held out to calibrate each view and to combine the views.
    In every round both views score all unlabelled documents; in round r each
    hands the other those it is surest of, up to r times ``per_round`` of them in
    proportion to the two kinds. The taker is fitted on its labelled rows and
    about ``handed_rows`` rows of each kind drawn from all that were handed over;
    drawn rows count for as many as they were drawn from. The threshold comes from
    the scores of all labelled documents that were not fitted on.
    """
    sizes = {r["_good"]: r["count"] for r in table.groupBy("_good").count().collect()}
    pool_size = sizes.pop(-1, 0)
    if len(sizes) < 2:
        return None
    rates = {k: min(1.0, fit_rows / 2 / n) for k, n in sizes.items()}
    limits = {k: int(np.ceil(r * HASHES)) for k, r in rates.items()}
    drawn = F.expr(f"_good = 0 AND _at < {limits[0]} OR _good = 1 AND _at < {limits[1]}")
    sample = _drawn(table.where(drawn))
    last_held = {}
    for kind in (0, 1):
        keys = np.unique(sample["_at"][sample["_good"] == kind])
        if len(keys) < 2:
            return None
        last_held[kind] = int(keys[max(1, len(keys) // 3) - 1])
    good = sample["_good"].to_numpy()
    whole = Rows(_matrix(sample["_view"]), good.astype(float), sample["_n"].to_numpy() / np.where(good, rates[1], rates[0]))
    is_held = sample["_at"].to_numpy() <= np.where(good, last_held[1], last_held[0])
    held, train = whole.part(is_held), whole.part(~is_held)
    width = text_view([b""]).shape[1]
    slices = (slice(0, width), slice(width, None))

    def fitted(v: int, views: np.ndarray, marks: np.ndarray, times: np.ndarray) -> Logistic:
        model = Logistic().fit(views[:, slices[v]], marks, times)
        return model.calibrate(held.views[:, slices[v]], held.good, held.times)

    model = CoTrained(*(fitted(v, train.views, train.good, train.times) for v in (0, 1)))
    pool = table.where("_good = -1")
    for turn in range(1, rounds + 1) if pool_size else ():
        given, handed = _handed(pool, model, sizes, turn * per_round * pool_size, confidence, handed_rows)
        if not handed:
            break
        model = CoTrained(
            *(
                fitted(
                    v,
                    np.concatenate([train.views, _matrix(views)]) if views else train.views,
                    np.concatenate([train.good, marks]),
                    np.concatenate([train.times, times]),
                )
                for v, (views, marks, times) in enumerate(given)
            ),
            exchanged=handed,
        )
    model.joint = Logistic(ridge=1.0).fit(model.logits(held.views), held.good, held.times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = batch.column(0).to_pylist()
            p = model.scores(_matrix(views))[:, 2] if views else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(_rejection(p)), batch.column(1)], ["at", "_good"])

    unseen = table.where(
        " OR ".join(f"_good = {k} AND (_at <= {last_held[k]} OR _at >= {limits[k]})" for k in (0, 1))
    )
    bins = unseen.select("_view", "_good").mapInArrow(run, "at bigint, _good int").groupBy("at", "_good").count().collect()
    best = calibrated_threshold([(r["at"], r["_good"], r["count"]) for r in bins], loss, SCALE)
    model.threshold = round(best * SCALE)
    return model


def _rejection(p_good: np.ndarray) -> np.ndarray:
    return np.floor((1.0 - p_good) * SCALE).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, **parameters) -> CoTrained | None:
    """Co-train on the labelled documents, exchanging pseudo-labels over all others.

    Null texts count as empty; a missing or null one of lang, source and n_chars is a
    value of its own. Rows equal in id and text are drawn together, counted as
    often as they occur. An empty table gives None.
    """
    return co_train(view_table(docs, labels), **parameters)


def _inputs(docs: DataFrame) -> list[Column]:
    return [
        text_bytes(),
        *[F.col(c).cast(t) if c in docs.columns else F.lit(None).cast(t)
          for c, t in zip(META, ("string", "string", "double"))],
    ]


def _views(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> np.ndarray:
    """Both views side by side, the text's first."""
    return np.column_stack([text_view(text.tolist()), metadata_view(lang.tolist(), source.tolist(), n_chars.tolist())])


def score(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """Add ``p_text``, ``p_meta``, ``p_good`` and ``kept``; no shuffle.

    A missing one of lang, source and n_chars, or a null in it, is a value of its
    own; a null text counts as empty. Without a model (no labels of both kinds)
    the probabilities are null and every document is kept. Equal rows score equal;
    whole texts count, however long; input columns named like an added one are replaced.
    """
    added = ("p_text", "p_meta", "p_good", "kept")
    needed = ("text", *META)
    held = packed(docs, *needed)
    if model is None:
        unknown = {c: F.lit(None).cast("double") for c in added[:3]} | {"kept": F.lit(True)}
        return held.withColumns(unknown).select(*unpacked(docs.columns, needed, added))

    @F.pandas_udf("p_text double, p_meta double, p_good double, kept boolean")
    def judged(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame(model.scores(_views(text, lang, source, n_chars)), columns=added[:3])
        return found.assign(kept=_rejection(found["p_good"].to_numpy()) < model.threshold)

    scored = held.withColumn("_p", judged(*_inputs(docs))).select(*held.columns, "_p.*")
    return scored.select(*unpacked(docs.columns, needed, added))


def classify(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """Fit on labelled and unlabelled documents, then score all of them."""
    return score(docs, fit(docs, labels, **parameters))
