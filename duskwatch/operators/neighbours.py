"""Exact nearest neighbours of vectors in a bank.

A bank of up to ``BROADCAST_VALUES`` entries (counted before it is fetched)
is broadcast and each Arrow batch of queries is compared with it as one matrix
product: no shuffle and no pair rows.

A larger bank is laid out around pivots: every bank vector belongs to the cell of
its nearest pivot, and of a cell only its size and its smallest and largest
distance to the pivot are known to everybody. A query first visits its own cell;
the ``k``-th distance found there and the triangle inequality then name the cells
that can still hold a nearer vector, and only these are visited by an equi-join.
Equal vectors meet once.

Where most cells can hold a nearer vector (vectors without clusters), a visit per
cell would move each query once per cell. Cells are then visited in groups of up
to a block of vectors, so a query moves once per block. Large groups, and many
visitors of one, are cut into blocks: no task holds more than two bounded matrices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from duskwatch.operators.samples import hash_sample
from duskwatch.plans.ordering import freeze

_STEP = 512  # query rows per matrix product
MOST_PIVOTS = 1024
# Entries of a bank that is broadcast (8 MB as doubles), and of a block of a larger one.
BROADCAST_VALUES = 1 << 20
BLOCK_VALUES = 1 << 21
# A query visits so many groups of cells on average, and meets so large a share of
# the bank, or the groups are made larger.
MOST_VISITS = 16
PRUNED_SHARE = 0.25
_SAMPLED = 1024  # queries this is estimated from
_COLUMNS = 4096  # bank rows per matrix product
_EXACT = 1 << 16  # pairs whose exact distance is taken at once


def _matrix(vectors) -> np.ndarray:
    return np.asarray([np.asarray(v, dtype=np.float64) for v in vectors], dtype=np.float64)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms > 0, norms, 1.0)


def _top(queries: np.ndarray, bank: np.ndarray, ids: np.ndarray, k: int, metric: str, own: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per query the distances and the bank places of the ``k`` smallest (distance, id).

    ``metric`` is ``euclidean``, ``cosine``, or ``unit`` for cosine distances of
    vectors that have unit length already. ``own`` holds the id each query must
    not be matched with.
    """
    if metric == "cosine":
        queries, bank = _unit(queries), _unit(bank)
    k = min(k, len(bank) - (1 if own is not None else 0))
    squares = (bank * bank).sum(axis=1)
    for start in range(0, len(queries), _STEP):
        part = queries[start : start + _STEP]
        if k <= 0:
            for _ in part:
                yield np.zeros(0), np.zeros(0, np.int64)
            continue
        rough = (part * part).sum(axis=1)[:, None] + squares[None, :] - 2.0 * part @ bank.T
        if own is not None:
            rough[own[start : start + _STEP, None] == ids[None, :]] = np.inf
        edge = np.partition(rough, k - 1, axis=1)[:, k - 1]
        # candidates with a margin for rounding, then exact distances
        row, col = np.nonzero(rough <= (edge + 1e-9 * (1.0 + np.abs(edge)))[:, None])
        gap = part[row] - bank[col]
        exact = (gap * gap).sum(axis=1)
        distance = np.sqrt(exact) if metric == "euclidean" else exact / 2.0
        order = np.lexsort((ids[col], distance, row))
        row, col, distance = row[order], col[order], distance[order]
        first = np.searchsorted(row, np.arange(len(part)))
        for i in range(len(part)):
            pick = slice(first[i], first[i] + k)
            yield distance[pick], col[pick]


def top_k(queries: np.ndarray, bank: np.ndarray, ids: np.ndarray, k: int, metric: str, own: np.ndarray | None):
    """Per query the k smallest (distance, id), ties by id."""
    return [list(zip(d.tolist(), ids[at].tolist())) for d, at in _top(queries, bank, ids, k, metric, own)]


def broadcast_rows(bank: DataFrame) -> int:
    """How many vectors of the length found in this bank make up ``BROADCAST_VALUES`` entries."""
    one = bank.select(F.size("vec")).first()
    return BROADCAST_VALUES // max(one[0] if one else 1, 1)


def collect_bank(bank: DataFrame, limit: int | None = None, carry: Sequence[str] = ()):
    """Ids, vectors and carried columns of a bank within the limit, ordered by id; None beyond it."""
    limit = broadcast_rows(bank) if limit is None else limit
    rows = bank.select("bank_id", "vec", *carry).limit(limit + 1).toPandas()
    if len(rows) > limit:
        return None
    rows = rows.sort_values("bank_id", kind="stable")
    matrix = _matrix(rows["vec"]) if len(rows) else np.zeros((0, 0))
    return rows["bank_id"].to_numpy(dtype=np.int64), matrix, {c: rows[c].to_numpy() for c in carry}


def _neighbour_type(bank: DataFrame, carry: Sequence[str]) -> T.ArrayType:
    fields = [T.StructField("distance", T.DoubleType()), T.StructField("bank_id", T.LongType())]
    return T.ArrayType(T.StructType([*fields, *[T.StructField(c, bank.schema[c].dataType) for c in carry]]))


def nearest(
    queries: DataFrame,
    bank: DataFrame,
    k: int,
    key: str,
    vec: str = "vec",
    metric: str = "euclidean",
    skip_self: bool = False,
    limit: int | None = None,
    carry: Sequence[str] = (),
    report: dict | None = None,
) -> DataFrame:
    """Add ``neighbours``: the ``k`` nearest ``(distance, bank_id, *carry)`` of ``bank(bank_id, vec, *carry)``.

    ``key`` matters only with ``skip_self``, where it is the bank id a query must
    not meet. ``limit`` is the number of vectors to broadcast at most (by default
    as many as make up ``BROADCAST_VALUES`` entries).
    ``report["pairs"]`` and ``report["visits"]`` receive the numbers of vector pairs
    compared, and of queries moved to a group of cells, by the route through pivots.
    """
    limit = broadcast_rows(bank) if limit is None else limit
    small = collect_bank(bank, limit, carry)
    if small is None:
        return _nearest_by_pivots(queries, bank, k, key, vec, metric, skip_self, carry, report)
    shared = queries.sparkSession.sparkContext.broadcast(small)

    @F.pandas_udf(_neighbour_type(bank, carry))
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ids, matrix, more = shared.value
        for own, vectors in batches:
            if not len(vectors) or not len(ids):
                yield pd.Series([[] for _ in range(len(vectors))])
                continue
            mine = own.to_numpy(dtype=np.int64) if skip_self else None
            names = ("distance", "bank_id", *more)
            yield pd.Series(
                [
                    [dict(zip(names, row)) for row in zip(d.tolist(), ids[at].tolist(), *[m[at].tolist() for m in more.values()])]
                    for d, at in _top(_matrix(vectors), matrix, ids, k, metric, mine)
                ]
            )

    own_id = F.col(key).cast("long") if skip_self else F.lit(0).cast("long")
    return queries.withColumn("neighbours", find(own_id, F.col(vec)))


# --- beyond the broadcast limit ---------------------------------------------------


class Cells:
    """Pivots and what is known of the bank vectors around each: bounded by the number of pivots."""

    def __init__(self, pivots: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.pivots, self.sizes, self.low, self.high = pivots, sizes, low, high
        self.between = np.array([np.linalg.norm(pivots - p, axis=1) for p in pivots])

    def gaps(self, matrix: np.ndarray) -> np.ndarray:
        squares = (matrix * matrix).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1)[None, :]
        return np.sqrt(np.maximum(squares - 2.0 * matrix @ self.pivots.T, 0.0))

    def slack(self, matrix: np.ndarray) -> float:
        """More than rounding can take from a distance."""
        most = max((matrix * matrix).sum(axis=1).max(initial=0.0), (self.pivots * self.pivots).sum(axis=1).max(initial=0.0))
        return 1e-6 * (1.0 + math.sqrt(most))

    def home(self, matrix: np.ndarray, want: int) -> list[np.ndarray]:
        """Per query the nearest cells that together hold ``want`` vectors."""
        order = np.argsort(np.where(self.sizes > 0, self.gaps(matrix), np.inf), axis=1, kind="stable")
        held = np.cumsum(self.sizes[order], axis=1)
        enough = np.minimum((held < want).sum(axis=1) + 1, int((self.sizes > 0).sum()))
        return [row[:n] for row, n in zip(order, enough)]

    def within(self, matrix: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """``[query, cell]``: whether the cell can hold a vector at most ``reach`` away.

        Three bounds: the vectors of a cell lie in a ring around its pivot, and on
        its side of the plane between its pivot and the pivot nearest to the query.
        """
        gaps = self.gaps(matrix)
        nearest = gaps.argmin(axis=1)
        first = gaps[np.arange(len(gaps)), nearest]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (gaps**2 - first[:, None] ** 2) / (2.0 * self.between[nearest])
        least = np.maximum(np.maximum(gaps - self.high, self.low - gaps), np.nan_to_num(plane, nan=0.0, posinf=0.0))
        return (least <= reach[:, None] + self.slack(matrix)) & (self.sizes > 0)[None, :]


def _stepped(matrix: np.ndarray) -> Iterator[slice]:
    """Slices of the rows, so that rows times pivots stay small whatever the Arrow batch."""
    return (slice(start, start + _STEP) for start in range(0, len(matrix), _STEP))


def _packed(cells: Cells, most: int) -> np.ndarray:
    """A group per cell: neighbouring cells together while they hold ``most`` vectors at most."""
    groups, count, todo = np.zeros(len(cells.sizes), np.int64), 0, [np.arange(len(cells.sizes))]
    while todo:
        part = todo.pop()
        if len(part) == 1 or cells.sizes[part].sum() <= most:
            groups[part] = count
            count += 1
            continue
        axis = cells.pivots[part].var(axis=0).argmax()
        part = part[np.argsort(cells.pivots[part, axis], kind="stable")]
        todo += [part[: len(part) // 2], part[len(part) // 2 :]]
    return groups


def _grouping(cells: Cells, visit: np.ndarray, block: int) -> np.ndarray:
    """The finest groups of cells that prune well for the sampled ``visit[query, cell]``, else groups as large as a block."""
    total = max(int(cells.sizes.sum()), 1)
    for most in (0, block // 64, block // 16, block // 4):
        groups = _packed(cells, most)
        held = np.bincount(groups, cells.sizes)
        seen = np.zeros((len(visit), len(held)), bool)
        for g in range(len(held)):
            seen[:, g] = visit[:, groups == g].any(axis=1)
        if not len(visit) or (seen.sum(axis=1).mean() <= MOST_VISITS and (seen @ held).mean() <= PRUNED_SHARE * total):
            return groups
    return _packed(cells, block)


def _column(table: pa.Table, name: str) -> np.ndarray:
    flat = table.column(name).combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _first_k(row: np.ndarray, distance: np.ndarray, spots: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` smallest (distance, spot) of each row, in this order."""
    order = np.lexsort((spots, distance, row))
    sorted_rows = row[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_rows, sorted_rows)
    return order[rank < k]


def _block_top(queries: np.ndarray, reach: np.ndarray, bank: np.ndarray, spots: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, ...]:
    """``row, distance, spot`` of the ``k`` smallest (distance, spot) of each query, none beyond its ``reach``.

    Rough squared distances come from matrix products, in single precision where
    its error is small against the reach; pairs that may be within the bound found
    so far get their exact distance.
    """
    squares = (bank * bank).sum(axis=1)
    dims, largest = bank.shape[1], squares.max()
    found = []
    for at in _stepped(queries):
        part = queries[at]
        own = (part * part).sum(axis=1)
        bound = np.square(reach[at]) if metric == "euclidean" else 2.0 * reach[at]  # of squared distances
        size = 4.0 * (dims + 4) * (own + largest)
        usual = np.median(bound)
        single = largest < 1e30 and own.max() < 1e30 and np.isfinite(usual) and np.median(size) * 2.0**-24 <= 0.02 * usual
        kind, slack = (np.float32, size * 2.0**-24) if single else (np.float64, size * 2.0**-53)
        left = np.column_stack([part, np.ones(len(part))]).astype(kind)
        row, exact, distance, spot = np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
        for start in range(0, len(bank), _COLUMNS):
            theirs = bank[start : start + _COLUMNS]
            rough = left @ np.column_stack([-2.0 * theirs, squares[start : start + _COLUMNS]]).T.astype(kind)
            near = np.flatnonzero(rough <= (bound - own + slack).astype(kind)[:, None])
            if len(near) > 4 * k * len(part) and len(theirs) >= k:
                # the bound is far off: the k-th of these columns is a nearer one
                bound = np.minimum(bound, np.partition(rough, k - 1, axis=1)[:, k - 1] + own + slack)
                near = np.flatnonzero(rough <= (bound - own + slack).astype(kind)[:, None])
            for piece in range(0, len(near), _EXACT):
                who, what = np.divmod(near[piece : piece + _EXACT], len(theirs))
                gap = part[who] - theirs[what]
                square = (gap * gap).sum(axis=1)
                row, exact = np.append(row, who), np.append(exact, square)
                distance = np.append(distance, np.sqrt(square) if metric == "euclidean" else square / 2.0)
                spot = np.append(spot, spots[start + what])
                kept = _first_k(row, distance, spot, k)
                row, exact, distance, spot = row[kept], exact[kept], distance[kept], spot[kept]
                full = np.flatnonzero(np.bincount(row, minlength=len(part)) == k)
                last = np.searchsorted(row, full, side="right") - 1
                bound[full] = np.minimum(bound[full], exact[last])
        found.append((row + at.start, distance, spot))
    return tuple(np.concatenate(parts) for parts in zip(*found))


_BEST = T.ArrayType(T.StructType([T.StructField("distance", T.DoubleType()), T.StructField("spot", T.LongType())]))


def _visits(pairs: DataFrame, placed: DataFrame, sizes: np.ndarray, k: int, metric: str, block: int, report: dict | None) -> DataFrame:
    """``q, best`` for every visit ``(q, vec, reach, place)`` to a block of ``placed(spot, vec, place)``: the ``k`` best ``(distance, spot)``."""
    spark = placed.sparkSession
    visitors = {r["place"]: r["count"] for r in pairs.groupBy("place").count().collect()}
    if report is not None:
        report["pairs"] = report.get("pairs", 0) + sum(n * int(sizes[c]) for c, n in visitors.items())
        report["visits"] = report.get("visits", 0) + sum(visitors.values())
    cuts = [(c, math.ceil(n / block), math.ceil(int(sizes[c]) / block)) for c, n in visitors.items()]
    plan = F.broadcast(spark.createDataFrame(cuts, "place int, chunks long, blocks long"))  # a row per cell at most
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = pairs.join(plan, "place").select(
        "q", "vec", "reach", "place", F.pmod(F.xxhash64("q"), "chunks").alias("chunk"), every("blocks").alias("block")
    )
    right = placed.join(plan, "place").select(
        "spot", "vec", "place", F.pmod(F.xxhash64("spot"), "blocks").alias("block"), every("chunks").alias("chunk")
    )

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        asked = mine.column("q").to_numpy()
        counts, distance, spot = np.zeros(len(asked), np.int64), np.zeros(0), np.zeros(0, np.int64)
        if len(mine) and len(theirs):
            spots = theirs.column("spot").to_numpy()
            row, distance, spot = _block_top(_column(mine, "vec"), mine.column("reach").to_numpy(), _column(theirs, "vec"), spots, k, metric)
            counts = np.bincount(row, minlength=len(asked))
        ends = np.append(0, np.cumsum(counts)).astype(np.int32)
        best = pa.StructArray.from_arrays([pa.array(distance), pa.array(spot)], names=["distance", "spot"])
        return pa.Table.from_arrays([pa.array(asked), pa.ListArray.from_arrays(pa.array(ends), best)], names=["q", "best"])

    keys = ["place", "block", "chunk"]
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("best", _BEST)])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    """``q, best``: the ``k`` best of all visits; a spot met twice counts once."""
    met = F.array_sort(F.array_distinct(F.flatten(F.collect_list("best"))))
    return found.groupBy("q").agg(F.slice(met, 1, k).alias("best"))


def _listed(found: DataFrame, k: int, carry: Sequence[str]) -> DataFrame:
    """``q, neighbours``: the members of the best spots ``q, distance, members``, ordered by distance and id."""

    def spread(spot: Column) -> Column:
        fields = ["bank_id", *carry]
        return F.transform(
            spot["members"], lambda m: F.struct(spot["distance"].alias("distance"), *[m[c].alias(c) for c in fields])
        )

    spots = F.collect_list(F.struct("distance", "members"))
    members = F.flatten(F.transform("_s", spread))
    by_place = F.array_sort(members, lambda a, b: _compare(a, b))
    return found.groupBy("q").agg(spots.alias("_s")).select("q", F.slice(by_place, 1, k).alias("neighbours"))


def _compare(a: Column, b: Column) -> Column:
    return (
        F.when(a["distance"] < b["distance"], -1)
        .when(a["distance"] > b["distance"], 1)
        .when(a["bank_id"] < b["bank_id"], -1)
        .when(a["bank_id"] > b["bank_id"], 1)
        .otherwise(0)
    )


def _nearest_by_pivots(queries, bank, k, key, vec, metric, skip_self, carry, report):
    spark = queries.sparkSession
    want = k + 1 if skip_self else k
    metric = "unit" if metric == "cosine" else metric

    # equal vectors are one spot; only their smallest ids can be among the nearest
    first = Window.partitionBy("vec").orderBy("bank_id")
    spots = freeze(
        bank.select("bank_id", *carry, F.col("vec").cast("array<double>").alias("vec"))
        .withColumn("_r", F.row_number().over(first))
        .filter(F.col("_r") <= want)
        .groupBy("vec")
        .agg(F.sort_array(F.collect_list(F.struct("bank_id", *carry))).alias("members"))
        .withColumn("spot", F.col("members")[0]["bank_id"])
    )
    count = spots.count()
    drawn = hash_sample(spots.select("spot", "vec"), "spot", min(MOST_PIVOTS, math.ceil(2 * math.sqrt(count)))).toPandas()
    pivots = _matrix(drawn["vec"])
    pivots = _unit(pivots) if metric == "unit" else pivots
    cells = Cells(pivots, np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots)))
    # arrays only: executors need not have this package
    bare = spark.sparkContext.broadcast((cells.pivots, cells.sizes, cells.low, cells.high))

    @F.pandas_udf("cell int, away double, vec array<double>")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cells = Cells(*bare.value)
        for vectors in batches:
            matrix = _unit(_matrix(vectors)) if metric == "unit" else _matrix(vectors)
            at, away = np.zeros(len(matrix), np.int32), np.zeros(len(matrix))
            for step in _stepped(matrix):
                gaps = cells.gaps(matrix[step])
                at[step], away[step] = gaps.argmin(axis=1), gaps.min(axis=1)
            yield pd.DataFrame({"cell": at, "away": away, "vec": list(matrix)})

    placed = freeze(spots.withColumn("_p", place("vec")).select("spot", "members", "_p.*"))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away"), F.max("away")).collect():
        cells.sizes[r[0]], cells.low[r[0]], cells.high[r[0]] = r[1], r[2], r[3]
    known = spark.sparkContext.broadcast((cells.pivots, cells.sizes, cells.low, cells.high))

    # equal queries are asked once
    distinct = queries.select(F.col(vec).cast("array<double>").alias("_v")).filter(F.col("_v").isNotNull()).distinct()

    @F.pandas_udf("vec array<double>, home array<int>")
    def begin(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cells = Cells(*known.value)
        for vectors in batches:
            matrix = _unit(_matrix(vectors)) if metric == "unit" else _matrix(vectors)
            homes = [home for step in _stepped(matrix) for home in cells.home(matrix[step], want)]
            yield pd.DataFrame({"vec": list(matrix), "home": homes})

    asked = freeze(distinct.withColumn("q", F.monotonically_increasing_id()).withColumn("_b", begin("_v")).select("q", "_v", "_b.*"))

    block = BLOCK_VALUES // max(pivots.shape[1] if pivots.ndim > 1 else 1, 1)
    at_home = asked.select("q", "vec", F.lit(float("inf")).alias("reach"), F.explode("home").alias("place"))
    near = freeze(_best(_visits(at_home, placed.withColumnRenamed("cell", "place"), cells.sizes, want, metric, block, report), want))
    reach = F.when(F.size("best") >= want, F.element_at("best", -1)["distance"]).otherwise(float("inf"))
    started = asked.join(near.select("q", reach.alias("reach")), "q")

    def span(reach: np.ndarray) -> np.ndarray:
        # cosine distances are half the squared distance of unit vectors
        return np.sqrt(2.0 * reach) if metric == "unit" else reach

    # how the cells are visited: a sample of the queries tells how many can hold a nearer vector
    sampled = F.pmod(F.xxhash64("q"), F.lit(max(asked.count() // _SAMPLED, 1))) == 0
    drawn = started.filter(sampled).select("vec", "reach").limit(2 * _SAMPLED).toPandas()
    visit = cells.within(_matrix(drawn["vec"]), span(drawn["reach"].to_numpy())) if len(drawn) else np.zeros((0, len(pivots)), bool)
    groups = _grouping(cells, visit, block)
    shared_groups = spark.sparkContext.broadcast(groups)

    @F.pandas_udf("array<int>")
    def further(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        cells, groups = Cells(*known.value), shared_groups.value
        for vectors, home, reach in batches:
            if not len(vectors):
                yield pd.Series([], dtype=object)
                continue
            matrix, limits, seen = _matrix(vectors), span(reach.to_numpy()), home.to_list()
            found = []
            for step in _stepped(matrix):
                for row, known_cells in zip(cells.within(matrix[step], limits[step]), seen[step]):
                    row[known_cells] = False
                    found.append(np.unique(groups[row]).astype(np.int32))
            yield pd.Series(found)

    more = freeze(started.select("q", "vec", "reach", further("vec", "home", "reach").alias("places")))
    grouped = placed.withColumn("place", F.get(F.lit(groups.tolist()).cast("array<int>"), F.col("cell")))
    again = more.select("q", "vec", "reach", F.explode("places").alias("place"))
    found = near.unionByName(_visits(again, grouped, np.bincount(groups, cells.sizes), want, metric, block, report))
    spread = _best(found, want).select("q", F.explode("best").alias("_n")).select("q", "_n.distance", "_n.spot")
    answers = asked.select("q", "_v").join(_listed(spread.join(placed.select("spot", "members"), "spot"), want, carry), "q").drop("q")
    joined = queries.join(answers, queries[vec].cast("array<double>") == answers["_v"], "left").drop("_v")
    if not skip_self:
        return joined
    others = F.filter("neighbours", lambda n: n["bank_id"] != F.col(key).cast("long"))
    return joined.withColumn("neighbours", F.slice(others, 1, k))
