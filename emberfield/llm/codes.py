"""Vector codes: product quantisation in exact integers over Hilbert-sorted blocks with boxes and sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Rows of one sorted chunk (fewer for long vectors: about CHUNK_VALUES components) and of one block in it.
CHUNK_ROWS = 8192
CHUNK_VALUES = 1 << 20
BLOCK_ROWS = 32
#: Integer components are held within this, so that squared distances and sums fit 64 bits.
LARGEST = 1 << 26
#: A Hilbert key has 64 bits at most; parts wider than this are ordered by their widest components.
CURVE_WIDTH = 32


def finite(vector: Column | str) -> Column:
    """Whether a vector is there, without null, infinite or undefined components."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """A column of lists as rows of ``width`` doubles, shorter lists filled with zeros, longer ones cut."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[at < width], at[at < width]] = values[at < width]
    return out


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), held within ``LARGEST``."""
    return np.floor(np.clip(vectors * scale, -LARGEST, LARGEST)).astype(np.int32)


def hilbert_order(points: np.ndarray) -> np.ndarray:
    """The order of integer points along a Hilbert curve through their box."""
    n, width = points.shape
    if n < 2 or not width:
        return np.arange(n)
    low, high = points.min(0).astype(np.int64), points.max(0).astype(np.int64)
    if width > CURVE_WIDTH:
        widest = np.sort(np.argsort(low - high, kind="stable")[:CURVE_WIDTH])
        points, low, high, width = points[:, widest], low[widest], high[widest], CURVE_WIDTH
    bits = min(16, 64 // width)
    spread = np.maximum(high - low, 1)
    x = ((points - low) * ((1 << bits) - 1) // spread).T.astype(np.uint64)
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):  # undo the rotations from the top bit down
        lower = np.uint64((1 << level) - 1)
        for i in range(width):
            is_set = (x[i] >> np.uint64(level)) & one == one
            swap = np.where(is_set, np.uint64(0), (x[0] ^ x[i]) & lower)
            x[0] ^= np.where(is_set, lower, swap)
            x[i] ^= swap
    for i in range(1, width):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros(n, np.uint64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(level)) & one == one, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros(n, np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(width):
            key = (key << one) | ((x[i] >> np.uint64(level)) & one)
    return np.argsort(key, kind="stable")


def _blocks(rows: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, least, greatest, sum of every block) for the rows of one part."""
    order = hilbert_order(rows)
    starts = np.arange(0, len(rows), block_rows)
    x = rows[order]
    return order.astype(np.int32), np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts), np.add.reduceat(x.astype(np.int64), starts)


def stored_chunks(rows: DataFrame, width: int, parts: int, scale: int, block_rows: int) -> DataFrame:
    """A row per chunk: ids, labels, the integers by part, and each part's Hilbert order, boxes and sums."""
    label = dict(rows.dtypes)["label"]
    most = max(1, min(CHUNK_ROWS, CHUNK_VALUES // (width * parts)))
    blob = lambda arrays: np.stack(arrays).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                piece = batch.slice(at, most)
                x = whole_numbers(matrix(piece.column(2), width * parts), scale).reshape(-1, parts, width).transpose(1, 0, 2)
                order, low, high, total = zip(*(_blocks(part, block_rows) for part in x))
                ends = pa.array([0, piece.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(ends, piece.column(0)), pa.ListArray.from_arrays(ends, piece.column(1)),
                    *[pa.array([blob(a)], pa.binary()) for a in (x, order, low, high, total)],
                ], ["ids", "labels", "x", "blocked", "low", "high", "total"])

    schema = f"ids array<long>, labels array<{label}>, x binary, blocked binary, low binary, high binary, total binary"
    return rows.select("vec_id", "label", "vector").mapInArrow(run, schema)


class Chunk:
    """One part of a stored chunk."""

    def __init__(self, row: dict, part: int, parts: int, width: int, block_rows: int) -> None:
        array = lambda name, kind, *shape: np.frombuffer(row[name], kind).reshape(parts, -1, *shape)[part]
        self.order = array("blocked", np.int32)
        self.x = array("x", np.int32, width)[self.order].astype(np.int64)
        self.low, self.high = array("low", np.int32, width).astype(np.int64), array("high", np.int32, width).astype(np.int64)
        self.total = array("total", np.int64, width)
        self.block = np.arange(len(self.order)) // block_rows
        self.sizes = np.bincount(self.block, minlength=len(self.low))

    def shortlists(self, book: np.ndarray) -> np.ndarray:
        """(blocks, entries): whether an entry can be the nearest of some row in the block's box.

        An entry is out if another's farthest point of the box is nearer than its own nearest one; equal distances stay
        in, so ties still go to the lower index.
        """
        near, far = [], []
        for entry in book:
            below, above = self.low - entry, entry - self.high
            near.append((np.maximum(np.maximum(below, above), 0) ** 2).sum(1))
            far.append((np.maximum(np.abs(below), np.abs(above)) ** 2).sum(1))
        near, far = np.array(near).T, np.array(far).T
        return near <= far.min(1, keepdims=True)

    def nearest(self, book: np.ndarray, listed: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of the given rows, each against its block's shortlist."""
        best, found = np.full(len(rows), np.iinfo(np.int64).max), np.zeros(len(rows), np.int32)
        x, block = self.x[rows], self.block[rows]
        for index, entry in enumerate(book):
            at = np.flatnonzero(listed[block, index])
            away = ((x[at] - entry) ** 2).sum(1)
            nearer = away < best[at]
            best[at[nearer]], found[at[nearer]] = away[nearer], index
        return found, best

    def gathered(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, component sums) of every entry's rows; a block with one entry on its list gives its stored sums."""
        n, total = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
        listed = self.shortlists(book)
        sure = listed.sum(1) == 1
        only = listed[sure].argmax(1)
        np.add.at(n, only, self.sizes[sure])
        np.add.at(total, only, self.total[sure])
        rows = np.flatnonzero(~sure[self.block])
        found, _ = self.nearest(book, listed, rows)
        np.add.at(n, found, 1)
        np.add.at(total, found, self.x[rows])
        return n, total


def _next_books(chunks: DataFrame, books: np.ndarray, block_rows: int) -> np.ndarray:
    """The codebooks after one round. The driver receives one row per part, entry and component."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                values = {name: batch.column(name)[row].as_py() for name in ("x", "blocked", "low", "high", "total")}
                for part in range(parts):
                    more = Chunk(values, part, parts, width, block_rows).gathered(books[part])
                    n[part] += more[0]
                    total[part] += more[1]
        at = np.indices(books.shape).reshape(3, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*map(pa.array, at), pa.array(np.repeat(n.ravel(), width)), pa.array(total.ravel())], ["part", "entry", "place", "n", "total"])

    told = chunks.select("x", "blocked", "low", "high", "total").mapInArrow(run, "part int, entry int, place int, n long, total long")
    summed = told.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    books = books.copy()
    for row in summed.where("n > 0").collect():
        books[row["part"], row["entry"], row["place"]] = int(row["total"]) // row["n"]
    return books


def _coded(chunks: DataFrame, books: np.ndarray, block_rows: int, label: str) -> DataFrame:
    """(vec_id, label, code, error) of every stored row."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                values = {name: batch.column(name)[row].as_py() for name in ("x", "blocked", "low", "high", "total")}
                ids = batch.column("ids")[row].values
                codes, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for part in range(parts):
                    chunk = Chunk(values, part, parts, width, block_rows)
                    found, away = chunk.nearest(books[part], chunk.shortlists(books[part]), np.arange(len(ids)))
                    codes[chunk.order, part] = found
                    error[chunk.order] += away
                texts = [c.tobytes().hex() for c in codes]
                yield pa.RecordBatch.from_arrays([ids, batch.column("labels")[row].values, pa.array(texts, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return chunks.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def vector_codes(
    vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
    scale: int = SCALE, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: every usable vector as one byte per part.

    Components become floor(``scale`` x); each of ``parts`` equal parts has a codebook of up to ``entries`` (256 at
    most) entries, which starts as that part of the rows of smallest vec_id (ties by vector, rows without an id last) and
    is replaced ``rounds`` times by the floored means of the rows nearest to its entries. Every task sorts the rows of a
    chunk along a Hilbert curve, part by part, and stores blocks of ``block_rows`` with their boxes and sums; in every
    round the distances between a box and the entries leave a shortlist, one entry on it takes the stored sums as they
    are, and more are told apart row by row in 64-bit integers. So no round moves a row: a task sends its sums, and the
    driver receives parts x entries x components of them. All results are exact and do not depend on the chunks.

    Rows whose vector is null or holds null or non-finite components are left out. Shorter vectors are filled with zeros
    to the longest, and that to a multiple of ``parts``; integers beyond 2^26 are held there. Repeated rows are rows of
    their own; null labels are one label; other columns are ignored; an empty table gives an empty result.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte per part: at most 256 entries")
    rows = vectors.where(finite(vector)).select("vec_id", "label", F.col(vector).cast("array<double>").alias("vector"))
    width = max(1, -(-(rows.agg(F.max(F.size("vector"))).first()[0] or 0) // parts))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    lists = pa.array([r["vector"] for r in first], pa.list_(pa.float64()))
    books = whole_numbers(matrix(lists, width * parts), scale).astype(np.int64).reshape(-1, parts, width).transpose(1, 0, 2)
    chunks = written(stored_chunks(rows, width, parts, scale, block_rows), "vector-chunks")
    for _ in range(rounds if len(first) else 0):
        books = _next_books(chunks, books, block_rows)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = written(_coded(chunks, books, block_rows, dict(rows.dtypes)["label"]), "vector-codes")
    by_label = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same rows in DuckDB SQL, for vectors of one length that ``parts`` divides."""
    assign = lambda books: f"""
 SELECT vec_id, p, x, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (
  SELECT vec_id, s.p, x, e, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x, c)])::BIGINT AS d FROM slices s JOIN {books} b ON b.p = s.p)
 GROUP BY vec_id, p, x"""  # noqa: E731
    steps = []
    for k in range(1, rounds + 1):
        steps.append(f""" near{k} AS MATERIALIZED ({assign(f'book{k - 1}')}),
 mean{k} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (
  SELECT p, e, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS m FROM (
   SELECT p, e, i, sum(v) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS v, unnest(range(len(x))) AS i FROM near{k}) GROUP BY p, e, i)) GROUP BY p, e),
 book{k} AS MATERIALIZED (SELECT o.p, o.e, coalesce(m.c, o.c) AS c FROM book{k - 1} o LEFT JOIN mean{k} m ON m.p = o.p AND m.e = o.e),""")
    last = f"book{rounds}"
    return f"""
WITH kept AS (
 SELECT vec_id, label, [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
 slices AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM (SELECT *, unnest(range({parts})) AS p FROM kept)),
 book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM slices QUALIFY e < {entries}),
{chr(10).join(steps)}
 final AS MATERIALIZED ({assign(last)}),
 coded AS (SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM final GROUP BY vec_id),
 digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM {last})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT h FROM digest) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""
