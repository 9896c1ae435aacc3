"""Substring deduplication: content-defined chunks by a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import discard, shuffles_freed, written
from .texts import by_batch, strings

#: Bytes that the rolling hash sees, mean chunk length, longest chunk.
GEAR_WINDOW = 16
MEAN_CHUNK = 32
LONGEST_CHUNK = 256
#: A repeated stretch counts from this many bytes on.
LEAST_BYTES = 100
#: Numbers of bytes beside a chunk whose 8-bit hashes it carries, and bytes compared beside a run of repeated chunks: a natural cut
#: depends on 16 bytes, so equal text never reaches further than a chunk and the most of these bytes without sharing a chunk.
BESIDE = (4, 8, 16, 32)
CONTEXT = BESIDE[-1]
REACH = 2 * LONGEST_CHUNK
#: Bytes of text that are hashed at once: its arrays stay in a core's cache.
BLOCK_BYTES = 1 << 18
GEAR_SEED = 2024
#: Up to so many repeated digests (8 bytes each) go to every task, so that only repeated chunks leave it; beyond, chunks are joined with them.
REPEATED_KEYS = 8_000_000

#: One 32-bit number per byte value, and one of 64 bits for the sums of whole chunks.
GEAR = np.random.default_rng(GEAR_SEED).integers(0, 1 << 32, 256, np.uint32)
LETTERS = np.random.default_rng(GEAR_SEED + 1).integers(0, 1 << 64, 256, np.uint64)
#: An odd factor per place, and its inverse modulo 2^64.
FACTOR = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def gear_hashes(data: np.ndarray, width: int = GEAR_WINDOW) -> np.ndarray:
    """The gear hash after every byte: sum of GEAR[b] << k for the byte k places back, over the last ``width`` bytes.

    Widths 1, 2, 4, 8 and so on follow from one another by one shift and one addition over the whole array.
    """
    return _widths(data, width)[width]


def _widths(data: np.ndarray, *widths: int) -> dict[int, np.ndarray]:
    """The gear hashes over several widths, powers of two in ascending order."""
    h, width, found = GEAR.take(data), 1, {}
    while True:
        if width in widths:
            found[width] = h.copy() if width < widths[-1] else h
        if width == widths[-1]:
            return found
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2


def chunk_ends(data: np.ndarray, stops: np.ndarray | None = None, hashes: np.ndarray | None = None) -> np.ndarray:
    """Where chunks end: after bytes whose hash has its lowest values, and where a chunk would grow too long.

    A cut depends on the 16 bytes before it alone, so insertions shift no later cut; forced cuts of an overlong chunk
    fall on the last lowest hash of the second half, so a repeated word is cut alike wherever it starts. ``data`` may hold several
    texts one after the other, which end at ``stops``: each is cut as if it stood alone.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    stops = np.array([n]) if stops is None else stops
    mixed = (gear_hashes(data) if hashes is None else hashes) & np.uint32(0xFFFF00)
    ends = np.flatnonzero(mixed < (65536 // MEAN_CHUNK << 8)) + 1
    begins = np.append(0, stops)[np.searchsorted(stops, ends)]
    ends = np.union1d(ends[ends - begins >= GEAR_WINDOW], stops[stops > 0])
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > LONGEST_CHUNK:
        extra = []
        for at, end in zip((ends - gaps)[gaps > LONGEST_CHUNK].tolist(), ends[gaps > LONGEST_CHUNK].tolist()):
            while end - at > LONGEST_CHUNK:
                back = mixed[at + LONGEST_CHUNK // 2:at + LONGEST_CHUNK][::-1]
                at += LONGEST_CHUNK - int(back.argmin())
                extra.append(at)
        ends = np.sort(np.concatenate([ends, extra])).astype(np.int64)
    return ends


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with doc_id as a struct of the id, whether it lacks, and a hash of the text.

    So two texts under one id, or without any, are two documents; ids come first in order, rows without one last.
    """
    return docs.select(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("body")).alias("doc_id"), "text")


def _blocks(column: pa.Array) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(first row, bytes, stops): the texts of a column, null as empty, one after the other in blocks of about ``BLOCK_BYTES``."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset:column.offset + len(column) + 1]
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK_BYTES, "right")) - 1)
        yield first, data[int(at[first]):int(at[last])].to_pybytes() if data else b"", at[first + 1:last + 1] - at[first]
        first = last


def _powers(factor: int, n: int) -> np.ndarray:
    """At least ``n`` powers of a factor modulo 2^64, kept for blocks of usual size."""
    if len(_POWERS.get(factor, ())) >= n:
        return _POWERS[factor]
    out = np.full(max(n, 2 * BLOCK_BYTES), factor, np.uint64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    if n <= 2 * BLOCK_BYTES:
        _POWERS[factor] = out
    return out


def chunk_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit number per chunk from its bytes alone: sum of LETTERS[b] * FACTOR^k, k being the byte's place in the chunk."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTERS.take(data) * _powers(FACTOR, len(data))[:len(data)], out=sums[1:])
    return ((sums[ends] - sums[starts]) * _powers(pow(FACTOR, -1, 1 << 64), len(data) + 1)[starts]).view(np.int64)


def _cut(data: bytes, stops: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, sums) of the chunks of texts that follow one another."""
    letters = np.frombuffer(data, np.uint8)
    ends = chunk_ends(letters, stops, hashes)
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    return starts, ends, chunk_sums(letters, starts, ends)


def _among(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where ``values`` are among sorted ``keys``; asked for in order, neighbours look at the same keys."""
    order = np.argsort(values)
    at = np.searchsorted(keys, values[order])
    return np.sort(order[keys[np.minimum(at, len(keys) - 1)] == values[order]]) if len(keys) else np.empty(0, np.int64)


def _hashes_beside(hashes: dict[int, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number per chunk: eight bits for each of ``BESIDE`` before it, then after it; whatever where a text has fewer bytes there."""
    out = np.zeros(len(starts), np.uint64)
    for side in (0, 1):
        for width in BESIDE:
            h = hashes[width]
            at = np.minimum(ends + (width - 1), len(h) - 1) if side else np.maximum(starts - 1, 0)
            out = out << np.uint64(8) | (h[at] >> np.uint32(24)).astype(np.uint64)
    return out.view(np.int64)


def most_bytes(differ: np.ndarray, side: int) -> np.ndarray:
    """How far two chunks' texts can be equal before (side 0) or after them (1), from the exclusive or of their ``beside``."""
    out = np.full(len(differ), REACH)
    for k in reversed(range(len(BESIDE))):
        out[differ >> (8 * (len(BESIDE) * (2 - side) - 1 - k)) & 0xFF != 0] = BESIDE[k] - 1
    return out


def _once(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A slice of (doc_id, text) without its repeated rows."""
    seen, keep = set(), []
    for row, mark in enumerate(zip(*[field.to_pylist() for field in batch.column(0).flatten()])):
        if mark not in seen:
            seen.add(mark)
            keep.append(row)
    return batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int64()))


def repeated_keys(docs: DataFrame) -> DataFrame:
    """(d0): the sums of chunks that come more than once, from one narrow pass with map-side counts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums = [_cut(data, stops)[2] for _, data, stops in _blocks(_once(batch).column(1))]
        d0, n = np.unique(np.concatenate(sums) if sums else np.empty(0, np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(d0), pa.array(n.astype(np.int32))], ["d0", "n"])

    found = by_batch(docs.select("doc_id", "text"), run, "d0 long, n int")
    return written(found.groupBy("d0").agg(F.sum("n").alias("n")).where("n > 1").select("d0"), "substring-keys")


def chunks(docs: DataFrame, keys: np.ndarray | None = None) -> DataFrame:
    """(doc_id, d0, d1, start, stop, beside): the chunks of every whole text in bytes of UTF-8, with their sums and 64-bit digests.

    ``beside`` holds hashes of the ``BESIDE`` bytes before and after the chunk. With sorted ``keys``, only chunks
    whose sum is among them.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = _once(batch)
        digest = xxhash.xxh3_64_intdigest
        rows, sums, digests, starts, stops, beside = [], [], [], [], [], []
        for first, data, until in _blocks(batch.column(1)):
            hashes = _widths(np.frombuffer(data, np.uint8), *BESIDE)
            begin, ends, sum_of = _cut(data, until, hashes[GEAR_WINDOW])
            if keys is not None:
                here = _among(keys, sum_of)
                begin, ends, sum_of = begin[here], ends[here], sum_of[here]
            beside.append(_hashes_beside(hashes, begin, ends))
            row = np.searchsorted(until, ends)  # a chunk's text is the first that ends there or later
            opens = np.append(0, until)[row]
            rows.append(first + row)
            sums.append(sum_of)
            digests.append(np.array([digest(data[a:b]) for a, b in zip(begin.tolist(), ends.tolist())], np.uint64).view(np.int64))
            starts.append(begin - opens)
            stops.append(ends - opens)
        joined = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
        columns = [batch.column(0).take(pa.array(joined(rows, np.int64))), pa.array(joined(sums, np.int64)), pa.array(joined(digests, np.int64)),
                   pa.array(joined(starts, np.int32)), pa.array(joined(stops, np.int32)), pa.array(joined(beside, np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "d0", "d1", "start", "stop", "beside"])

    kind = dict(docs.dtypes)["doc_id"]
    return by_batch(docs.select("doc_id", "text"), run, f"doc_id {kind}, d0 long, d1 long, start int, stop int, beside long")


def repeated_chunks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, start, stop, first_doc_id, first_start, differ), the stored chunks that it reads): chunks whose digest also comes in an earlier place.

    The first place, by doc_id and then by start, keeps its chunk. ``differ`` tells for :func:`most_bytes` how many bytes
    beside both places may be equal. A first pass finds the digests that repeat; only their chunks are stored and moved in
    full. Counts and first places meet in map-side aggregates; the rows of a very frequent chunk are the long side of a
    join, which adaptive execution splits.
    """
    often = repeated_keys(docs)
    if often.count() <= REPEATED_KEYS:
        pieces = chunks(docs, np.sort(often.toArrow().column("d0").to_numpy()))
    else:
        pieces = chunks(docs).join(often, "d0", "left_semi").select("doc_id", "d0", "d1", "start", "stop", "beside")
    pieces = written(pieces, "substring-chunks")
    discard(often)
    first = pieces.groupBy("d0", "d1").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "start", "beside")).alias("first")
    ).where("n > 1").drop("n")
    hits = pieces.join(first, ["d0", "d1"]).where(F.struct("first.doc_id", "first.start") < F.struct("doc_id", "start"))
    hits = hits.select(
        "doc_id", "start", "stop", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"),
        F.col("beside").bitwiseXOR(F.col("first.beside")).alias("differ"),
    )
    return hits, pieces


def _beside(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, at, side, run, first_id, first_at) with bytes: what stands after (odd side) or, backwards, before a place.

    Sides from 2 on reach over ``REACH`` bytes, others over ``CONTEXT``. Texts travel to their places once, and a text
    holds no more places than its length allows.
    """
    kind = dict(docs.dtypes)["doc_id"]
    per_doc = wanted.groupBy(F.col("doc_id").alias("want_id")).agg(F.collect_list(F.struct("at", "side", "run", "first_id", "first_at")).alias("places"))
    rows = docs.select("doc_id", "text").dropDuplicates(["doc_id"]).join(per_doc, F.col("doc_id") == F.col("want_id")).select("doc_id", "text", "places")
    names = ["at", "side", "run", "first_id", "first_at"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        places = batch.column(2).flatten()
        row = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
        texts = [text.encode("utf-8", "surrogatepass") for text in strings(batch.column(1))]
        found = []
        for r, at, side in zip(row.tolist(), places.field("at").to_pylist(), places.field("side").to_pylist()):
            reach = REACH if side >= 2 else CONTEXT
            found.append(texts[r][at:at + reach] if side % 2 else texts[r][max(0, at - reach):at][::-1])
        columns = [batch.column(0).take(pa.array(row)), *[places.field(n) for n in names], pa.array(found, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "bytes"])

    return by_batch(rows, run, f"doc_id {kind}, at int, side int, run long, first_id {kind}, first_at int, bytes binary")


def _extended(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``runs`` with start and stop moved over the bytes beside them that also stand beside their first places.

    Inside one document neither side reaches into the other place.
    """
    kind = dict(docs.dtypes)["doc_id"]
    edge = lambda side, at, first_at: F.struct((F.col(("left", "right")[side]).cast("int") * 2 + side).alias("side"), F.col(at).alias("at"), F.col(first_at).alias("first_at"))
    edges = runs.select("doc_id", "run", F.col("first_doc_id").alias("first_id"), F.explode(F.array(
        edge(0, "start", "first_start"), edge(1, "stop", "first_stop")
    )).alias("e")).select("doc_id", "e.at", "e.side", "run", "first_id", "e.first_at")
    firsts = edges.select(F.col("first_id").alias("doc_id"), F.col("first_at").alias("at"), "side").distinct().select(
        "*", F.lit(None).cast("long").alias("run"), F.lit(None).cast(kind).alias("first_id"), F.lit(None).cast("int").alias("first_at"))
    texts = written(_beside(docs, edges.unionByName(firsts)), "substring-edges")
    own = texts.where("run is not null").select("doc_id", "run", "side", "first_id", "first_at", "bytes")
    there = texts.where("run is null").select(F.col("doc_id").alias("first_id"), F.col("at").alias("first_at"), "side", F.col("bytes").alias("first_bytes"))
    both = own.join(there, ["first_id", "first_at", "side"]).select("doc_id", "run", "side", "bytes", "first_bytes")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        more = []
        for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            n = min(len(a), len(b))
            differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
            more.append(n - (differ.bit_length() + 7) // 8)
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(more, pa.int32())], ["doc_id", "run", "side", "more"])

    grown = by_batch(both, run, f"doc_id {dict(docs.dtypes)['doc_id']}, run long, side int, more int").groupBy("doc_id", "run").agg(
        F.max(F.when(F.col("side") % 2 == 0, F.col("more"))).alias("more_left"), F.max(F.when(F.col("side") % 2 == 1, F.col("more"))).alias("more_right")
    )
    grown = written(grown, "substring-grown")
    discard(texts)
    own = F.col("first_doc_id") == F.col("doc_id")
    left, right = F.coalesce("more_left", F.lit(0)), F.coalesce("more_right", F.lit(0))
    room = F.greatest(F.col("start") - F.col("first_stop"), F.lit(0))
    left = F.when(own, F.least(left, room)).otherwise(left)
    right = F.when(own, F.least(right, room - left)).otherwise(right)
    return runs.join(grown, ["doc_id", "run"], "left").withColumns({"start": F.col("start") - left, "stop": F.col("stop") + right})


def repeated_spans(docs: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """doc_id, start, stop, first_doc_ids, n_chunks: every text's stretches that come earlier too; see :func:`stretches`."""
    return stretches(keyed(docs), least_bytes).withColumn("doc_id", F.col("doc_id.id"))


def _changes(column: pa.StructArray) -> np.ndarray:
    """Whether a row differs from the one before it; the first one does. A field that is null in one of two has a flag beside it."""
    out = np.arange(len(column)) == 0
    for field in column.flatten():
        out[1:] |= pc.not_equal(field[1:], field[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
    return out


def _joined(hits: pa.RecordBatch, least_bytes: int) -> list[pa.Array]:
    """The runs of whole documents' repeated chunks, which are sorted by document and start; see :func:`_runs`."""
    number = lambda name: hits.column(name).to_numpy().astype(np.int64)
    new = _changes(hits.column("doc_id"))
    again = ~new
    again[1:] &= np.diff(number("start")) == 0  # rows that come twice
    if again.any():
        hits, new = hits.filter(pa.array(~again)), new[~again]
    start, stop, first_start, differ = number("start"), number("stop"), number("first_start"), number("differ")
    first_stop = first_start + stop - start
    along = ~new & ~_changes(hits.column("first_doc_id"))
    along[1:] &= (start[1:] == stop[:-1]) & (first_start[1:] == first_stop[:-1])
    head = np.flatnonzero(~along)
    tail = np.append(head[1:], len(along)) - 1
    left, right = most_bytes(differ[head], 0), most_bytes(differ[tail], 1)
    # runs that could touch once grown stay or go together; documents are set far apart
    apart = np.cumsum(new[head]) << 33
    begin, end = np.maximum(start[head] - left, 0) + apart, stop[tail] + right + apart
    group = np.flatnonzero(np.append(True, np.minimum.accumulate(begin[::-1])[::-1][1:] > np.maximum.accumulate(end)[:-1]))
    size = np.maximum.reduceat(end, group) - np.minimum.reduceat(begin, group)
    kept = np.flatnonzero(np.repeat(size >= least_bytes, np.diff(np.append(group, len(head)))))
    head, tail, ints = head[kept], tail[kept], lambda a: pa.array(a, pa.int32())
    ids = lambda name: hits.column(name).take(pa.array(head))
    return [ids("doc_id"), pa.array(kept), ints(start[head]), ints(stop[tail]), ids("first_doc_id"), ints(first_start[head]),
            ints(first_stop[tail]), pa.array(tail - head + 1), pa.array(left[kept] == REACH), pa.array(right[kept] == REACH)]


def _runs(docs: DataFrame, least_bytes: int) -> DataFrame:
    """The runs of repeated chunks that can reach ``least_bytes``, alone or with runs they can touch, stored.

    ``left`` and ``right`` tell whether they may grow by ``CONTEXT`` bytes or more.
    """
    hits, pieces = repeated_chunks(docs)
    hits = hits.repartition("doc_id").sortWithinPartitions("doc_id.body", "doc_id.no_id", "doc_id.id", "start")
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda parts: pa.RecordBatch.from_arrays(_joined(pa.Table.from_batches(parts).combine_chunks().to_batches()[0], least_bytes), names)
        held: list[pa.RecordBatch] = []  # of one document, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id")
            if held and held[-1].column("doc_id")[-1].as_py() != ids[0].as_py():
                yield out(held)
                held = []
            at = int(np.flatnonzero(_changes(ids))[-1])
            if at:
                yield out([*held, batch.slice(0, at)])
                held = []
            held.append(batch.slice(at))
        if held:
            yield out(held)

    names = ["doc_id", "run", "start", "stop", "first_doc_id", "first_start", "first_stop", "n", "left", "right"]
    runs = hits.mapInArrow(run, f"doc_id {kind}, run long, start int, stop int, first_doc_id {kind}, first_start int, first_stop int, n long, left boolean, right boolean")
    runs = written(runs, "substring-runs")
    discard(pieces)
    return runs


def stretches(docs: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """doc_id, start, stop, first_doc_ids, n_chunks for documents from :func:`keyed`: stretches of a text that come in an earlier place.

    Bytes of the UTF-8 text, end exclusive. Chunks that follow one another here and at their first place form a run,
    which grows to both sides as far as the bytes beside its first place are equal; runs that touch form one stretch. Stretches under
    ``least_bytes`` do not count. An earlier place is an earlier document or the same one further up. ``first_doc_ids``
    lists the ids of the documents that come first with at least ``least_bytes`` of it, where the text stays. Rows without an
    id are searched like others, come after them and are not listed; an id with several texts is several documents;
    repeated rows are one; rows without text have no stretch; other columns are ignored; an empty table gives an empty result.
    """
    with shuffles_freed(docs.sparkSession):
        runs = _extended(docs, _runs(docs, least_bytes))
    order = W.partitionBy("doc_id").orderBy("start", "run")
    reached = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    runs = runs.withColumn("apart", F.coalesce((F.col("start") > reached).cast("int"), F.lit(1)))
    runs = runs.withColumn("stretch", F.sum("apart").over(order.rowsBetween(W.unboundedPreceding, 0)))
    of_first = W.partitionBy("doc_id", "stretch", "first_doc_id").orderBy("start", "run").rowsBetween(W.unboundedPreceding, -1)
    covered = F.greatest(F.col("start"), F.coalesce(F.max("stop").over(of_first), F.col("start")))
    parts = runs.withColumn("fresh", F.greatest(F.col("stop") - covered, F.lit(0))).groupBy("doc_id", "stretch", "first_doc_id").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n"), F.sum("fresh").alias("bytes"),
    )
    return parts.groupBy("doc_id", "stretch").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"),
        F.array_sort(F.collect_list(F.when(F.col("bytes") >= least_bytes, F.col("first_doc_id.id")))).alias("first_doc_ids"),
        F.sum("n").alias("n_chunks"),
    ).where(F.col("stop") - F.col("start") >= least_bytes).drop("stretch")


def without_repeats(docs: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``docs`` with the repeated stretches cut out of ``text`` (and ``n_chars``, if there, counted anew).

    A character of which a stretch holds only some bytes is cut as a whole. Documents without a stretch stay as they are;
    each text is cut at its own stretches, also where ids repeat or lack.
    """
    spans = stretches(keyed(docs), least_bytes).groupBy(F.col("doc_id").alias("_cut_key")).agg(
        F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_cut_spans")
    )
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("body"))
    joined = docs.withColumn("_own_key", key).join(spans, F.col("_own_key") == F.col("_cut_key"), "left").drop("_cut_key", "_own_key")
    names, at = joined.columns, joined.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, cuts = batch.column(at).to_pylist(), batch.column(len(names) - 1).to_pylist()
        out = []
        for text, spans_of in zip(texts, cuts):
            if spans_of:
                data = text.encode("utf-8", "surrogatepass")
                edges = [0, *[x for s in spans_of for x in (s["start"], s["stop"])], len(data)]
                text = b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2])).decode("utf-8", "ignore")
            out.append(text)
        columns = list(batch.columns[:-1])
        columns[at] = pa.array(out, pa.string())
        if "n_chars" in names:
            counted = [n if not s else len(t) for n, s, t in zip(batch.column(names.index("n_chars")).to_pylist(), cuts, out)]
            columns[names.index("n_chars")] = pa.array(counted, batch.column(names.index("n_chars")).type)
        return pa.RecordBatch.from_arrays(columns, names[:-1])

    return by_batch(joined, run, docs.schema)
