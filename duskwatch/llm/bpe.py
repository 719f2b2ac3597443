"""Byte-level BPE: encoding and decoding by DuckDB queries inside each partition.

Encoding: the distinct pre-tokens ("words") of a batch become rows (word, position,
token). A recursive query joins every pair of neighbours with the merge table and
contracts each word's minimum-rank pair, leftmost first, until no pair can merge.
Decoding: rows (position, id) join the vocabulary, and an ordered aggregation puts
the bytes together again.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import handing_back, packed, text_bytes, unpacked

# Words encoded by one recursive query, bytes of them, and ids decoded by one query.
WORDS_PER_QUERY = 50_000
BYTES_PER_QUERY = 1 << 20
IDS_PER_QUERY = 1 << 20
# Encoded words a task remembers; beyond that it forgets all and goes on.
REMEMBERED = 400_000

# Words up to this many bytes are contracted together, one pair of each per round.
SHORT = 64

# Rows form a chain: ``following`` and ``next_pos`` name the token after each, so a
# round needs hash joins only and no ordering. Of the two rows of a pair the latter
# stays, with the merged token: what follows it is what it was.
CONTRACT = """
WITH RECURSIVE step(word, pos, token, following, next_pos, live) AS (
  SELECT word, pos, token, following, next_pos, true FROM start
  UNION ALL
  SELECT s.word, s.pos, CASE WHEN s.pos = b.eaten THEN b.merged ELSE s.token END,
    CASE WHEN s.next_pos = b.pos THEN b.merged ELSE s.following END,
    CASE WHEN s.next_pos = b.pos THEN b.eaten ELSE s.next_pos END,
    b.word IS NOT NULL
  FROM step s LEFT JOIN (
    SELECT word, (best & 4294967295)::INT AS pos, (best >> 32)::INT AS merged, eaten
    FROM (
      SELECT p.word, min(m.merged::BIGINT << 32 | p.pos) AS best,
        arg_min(p.next_pos, m.merged::BIGINT << 32 | p.pos) AS eaten
      FROM step p JOIN merges m ON m.first = p.token AND m.second = p.following
      WHERE p.live GROUP BY p.word
    )
  ) b ON b.word = s.word
  WHERE s.live AND (b.word IS NULL OR s.pos <> b.pos)
)
SELECT word, token FROM step WHERE NOT live ORDER BY word, pos
"""
# The same for one long word, but all pairs of the lowest rank in one round, leftmost
# first and without overlap. That differs from one pair a round only if a contraction
# brings up a pair of a lower rank; ``bad`` tells, and the word then goes pair by pair.
CONTRACT_LONG = """
WITH RECURSIVE step(pos, token, live, low, bad) AS (
  SELECT pos, token, true, -1, false FROM start
  UNION ALL
  SELECT pos, CASE WHEN picked THEN merged ELSE token END, best IS NOT NULL, coalesce(best, low),
    bad OR coalesce(best < low, false) OR bool_or(picked AND coalesce(early < merged, false)) OVER ()
  FROM (
    SELECT *, coalesce(lag(picked) OVER (ORDER BY pos), false) AS eaten
    FROM (
      SELECT *, hit AND (row_number() OVER (PARTITION BY hit, run ORDER BY pos)) % 2 = 1 AS picked
      FROM (
        SELECT *, nth - row_number() OVER (PARTITION BY hit ORDER BY pos) AS run
        FROM (
          SELECT p.*, m.merged, e.merged AS early, min(m.merged) OVER () AS best,
            coalesce(m.merged = min(m.merged) OVER (), false) AS hit
          FROM (
            SELECT pos, token, low, bad, lead(token) OVER w AS following, lead(token, 2) OVER w AS third,
              row_number() OVER w AS nth
            FROM step WHERE live WINDOW w AS (ORDER BY pos)
          ) p
          LEFT JOIN merges m ON m.first = p.token AND m.second = p.following
          LEFT JOIN merges e ON e.first = m.merged AND e.second = p.third
        )
      )
    )
  ) WHERE NOT eaten
)
SELECT bool_or(bad) AS bad, list(token ORDER BY pos) AS ids FROM step WHERE NOT live
"""
ASSEMBLE = """
SELECT list(v.piece ORDER BY r.pos) AS pieces, count(v.piece) AS known
FROM rows r LEFT JOIN vocabulary v ON v.id = r.id
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file (base64 token and rank per line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_table(ranks: dict[bytes, int]) -> np.ndarray:
    """Rows (first, second, merged): every split of a token into two tokens."""
    rows = []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            first, second = ranks.get(token[:cut]), ranks.get(token[cut:])
            if first is not None and second is not None:
                rows.append((first, second, rank))
    return np.array(rows, np.int32).reshape(-1, 3)


def _connect():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
    con.execute("SET preserve_insertion_order = false")
    return con


class Numbers(dict):
    """Numbers keys by their first look-up."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


class Encoder:
    """Encodes words of one task; keeps what it has encoded.

    ``numbers`` gives each word a number n; its ids are the ``sizes[n]`` entries of
    ``pool`` from ``starts[n]`` on.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, table: np.ndarray):
        import regex

        self.find = regex.compile(pattern).findall
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack single bytes: {missing[:5]}")
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.ranks = ranks
        self.con = _connect()
        held = pa.table({n: table[:, i] for i, n in enumerate(("first", "second", "merged"))})
        self.con.register("held", held)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM held")
        self.con.unregister("held")
        self._forget()

    def _forget(self) -> None:
        self.numbers = Numbers()
        self.starts = self.sizes = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.int32)

    def learn(self) -> None:
        """Encode the words numbered since the last call; one that is itself a token takes that token."""
        found = [(np.zeros(0, np.int64),) * 3]  # numbers, sizes, ids
        batch: list[tuple[int, bytes]] = []
        size = 0
        whole: list[tuple[int, int]] = []
        old = len(self.sizes)
        for number, word in enumerate(islice(self.numbers, old, None), old):
            raw = word.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                whole.append((number, rank))
                continue
            ids = self._contract_long(raw) if len(raw) > SHORT else None
            if ids is not None:
                found.append((np.array([number]), np.array([len(ids)]), ids))
            elif raw:
                batch.append((number, raw))
                size += len(raw)
            if len(batch) >= WORDS_PER_QUERY or size >= BYTES_PER_QUERY:
                found.append(self._contract(batch))
                batch, size = [], 0
        if batch:
            found.append(self._contract(batch))
        if whole:
            both = np.array(whole, np.int64)
            found.append((both[:, 0], np.ones(len(both), np.int64), both[:, 1]))
        numbers, sizes, ids = (np.concatenate(c) for c in zip(*found))
        more = np.zeros((2, len(self.numbers) - old), np.int32)
        more[0, numbers - old] = len(self.pool) + np.cumsum(sizes) - sizes
        more[1, numbers - old] = sizes
        self.starts, self.sizes = np.append(self.starts, more[0]), np.append(self.sizes, more[1])
        self.pool = np.append(self.pool, ids.astype(np.int32))

    def _start(self, raw: list[bytes]) -> None:
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        first = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(raw), np.uint8)
        token = self.of_byte[data]
        pos = (np.arange(len(data)) - np.repeat(first, lengths)).astype(np.int32)
        following, next_pos = np.append(token[1:], -1).astype(np.int32), pos + 1
        last = first + lengths - 1
        following[last] = next_pos[last] = -1
        start = pa.table(
            {
                "word": np.repeat(np.arange(len(raw), dtype=np.int32), lengths),
                "pos": pos,
                "token": token,
                "following": following,
                "next_pos": next_pos,
            }
        )
        self.con.register("start", start)

    def _contract_long(self, raw: bytes) -> np.ndarray | None:
        self._start([raw])
        found = self.con.sql(CONTRACT_LONG).to_arrow_table()
        self.con.unregister("start")
        if found.column("bad")[0].as_py():
            return None
        return found.column("ids").combine_chunks().flatten().to_numpy()

    def _contract(self, words: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._start([raw for _, raw in words])
        ids = self.con.sql(CONTRACT).to_arrow_table()
        self.con.unregister("start")
        sizes = np.bincount(ids.column("word").to_numpy(), minlength=len(words))
        return np.array([number for number, _ in words]), sizes, ids.column("token").to_numpy()

    def encode(self, texts: list[str]) -> pa.ListArray:
        """Ids of each text."""
        if len(self.numbers) > REMEMBERED:
            self._forget()
        number = self.numbers.__getitem__
        split = [np.fromiter(map(number, words), np.int32, len(words)) for words in map(self.find, texts)]
        self.learn()
        words = np.concatenate([np.zeros(0, np.int32), *split])
        sizes = self.sizes[words]
        ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
        offsets = ends[np.cumsum([0, *map(len, split)])]
        at = np.repeat(self.starts[words] - ends[:-1], sizes)
        at += np.arange(len(at), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.pool[at]))


def _slices(batch: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose sizes sum to about ``limit``."""
    at, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        held += size
        if held >= limit:
            yield at, i + 1
            at, held = i + 1, 0
    if at < batch.num_rows:
        yield at, batch.num_rows


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` without its text and with ``ids``: the ids of the whole text, special tokens off.

    Each match of ``pattern`` is encoded separately. A null text counts as empty
    and gives an empty list; an empty table gives no rows. Repeated rows each
    count; an input column named ``out`` is replaced. Memory is bounded by
    the batch, the words a task remembers and the longest text.
    """
    ranks = read_ranks(ranks_path)
    held = docs.sparkSession.sparkContext.broadcast((ranks, merge_table(ranks)))  # the vocabulary
    rest = [c for c in docs.columns if c not in (text_col, out)]
    narrow = docs.select(*rest, text_bytes(text_col).alias("_text"))
    schema = narrow.drop("_text").withColumn(out, F.lit(None).cast("array<int>")).schema
    return narrow.mapInArrow(_encoding(lambda: held.value, pattern, rest, out), schema)


def _encoding(vocabulary: Callable, pattern: str, rest: list[str], out: str):
    """Batches of ``rest`` and a text as bytes to batches of ``rest`` and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(vocabulary()[0], pattern, vocabulary()[1])
            column = batch.column(batch.num_columns - 1)
            sizes = np.array([len(t.as_buffer()) for t in column], np.int64)
            for a, b in _slices(batch, sizes, 4 << 20):
                texts = [t.decode("utf-8", "replace") for t in column.slice(a, b - a).to_pylist()]
                ids = encoder.encode(texts)
                kept = [batch.column(i).slice(a, b - a) for i in range(len(rest))]
                yield pa.RecordBatch.from_arrays([*kept, ids], [*rest, out])
        if encoder:
            encoder.con.close()

    return run


def _joined(pieces: pa.BinaryArray, edges: np.ndarray) -> list[bytes]:
    """The bytes from each edge to the next; pieces lie next to each other."""
    if not len(pieces):
        return [b""] * (len(edges) - 1)
    ends = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1, 4 * pieces.offset)
    data = memoryview(pieces.buffers()[2])
    at = ends[edges].tolist()
    return [bytes(data[a:b]) for a, b in zip(at, at[1:])]


def decode(rows: DataFrame, ranks_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``decoded`` (binary): the bytes of the ids in order, by ordered aggregation.

    A null or empty list decodes to no bytes; an id outside the vocabulary is an
    error. Repeated rows each count; an input column named ``out`` is replaced.
    Texts longer than one query's share of ids are decoded in pieces.
    """
    rows = rows.drop(out)
    held = rows.sparkSession.sparkContext.broadcast((read_ranks(ranks_path),))
    schema = rows.withColumn(out, F.lit(None).cast("binary")).schema
    return rows.mapInArrow(_decoding(lambda: held.value, ids_col, out), schema)


def _decoding(vocabulary: Callable, ids_col: str, out: str):
    """Batches with ids to batches with their bytes besides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = None
        for batch in batches:
            if con is None:
                con = _connect()
                items = sorted((r, t) for t, r in vocabulary()[0].items())
                con.register(
                    "held",
                    pa.table({"id": pa.array([i for i, _ in items], pa.int32()), "piece": [t for _, t in items]}),
                )
                con.execute("CREATE TABLE vocabulary AS SELECT * FROM held")
            column = batch.column(batch.schema.get_field_index(ids_col))
            lengths = np.array([len(v) if v.is_valid else 0 for v in column], np.int64)
            for a, b in _slices(batch, lengths, IDS_PER_QUERY):
                part = column.slice(a, b - a)
                flat = part.flatten().to_numpy(zero_copy_only=False)
                edges = np.append(0, np.cumsum(lengths[a:b]))
                texts = [b""] * (b - a)
                for at in range(0, len(flat), IDS_PER_QUERY):
                    end = min(len(flat), at + IDS_PER_QUERY)
                    rows = pa.table({"pos": np.arange(end - at, dtype=np.int32), "id": flat[at:end]})
                    con.register("rows", rows)
                    found = con.sql(ASSEMBLE).to_arrow_table().combine_chunks()
                    con.unregister("rows")
                    if found.column("known")[0].as_py() != end - at:
                        raise ValueError("an id is not in the vocabulary")
                    pieces = found.column("pieces").combine_chunks().flatten()
                    for i, text in enumerate(_joined(pieces, np.clip(edges, at, end) - at)):
                        texts[i] += text
                kept = [c.slice(a, b - a) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.binary())], [*batch.schema.names, out])
        if con is not None:
            con.close()

    return run


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``docs`` with each text replaced by the decoding of its encoding (null: null), ``ids`` and ``n_tokens``.

    Input columns named ids or n_tokens are replaced. Both ways run in one Python
    worker per task, which holds the vocabulary once.
    """
    ranks = read_ranks(ranks_path)
    held = docs.sparkSession.sparkContext.broadcast((ranks, merge_table(ranks)))  # the vocabulary
    narrow = packed(docs, "text").withColumn("_null", F.col("text").isNull())
    rest = [c for c in narrow.columns if c != "text"]
    schema = narrow.drop("text").withColumns(
        {"ids": F.lit(None).cast("array<int>"), "decoded": F.lit(None).cast("binary")}
    ).schema
    encoded = _encoding(lambda: held.value, pattern, rest, "ids")
    decoded = _decoding(lambda: held.value, "ids", "decoded")
    both = handing_back(lambda batches: decoded(encoded(batches)))
    back = narrow.select(*rest, text_bytes().alias("_text")).mapInArrow(both, schema)
    text = F.when(~F.col("_null"), F.col("decoded").cast("string"))
    return back.withColumns({"text": text, "n_tokens": F.size("ids").cast("bigint")}).select(
        *unpacked(docs.columns, ("text",), ("ids", "n_tokens"))
    )
