"""Phrase collocations by SETM: sorted occurrence relations are merge-joined, group-counted and semi-joined level by level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import discard, shuffles_freed, work_path, written
from .texts import by_batch, whole

LONGEST = 4
LEAST_COUNT = 30
#: A phrase goes if a longer candidate around it has this share of its occurrences, in percent.
COVERED_PERCENT = 80
PER_LANG = 2000
#: Bytes of text that make one sorted relation, and bytes of one text that are split into words at a time.
RELATION_BYTES = 8 << 20
SEGMENT_BYTES = 1 << 20
#: Frequent keys go to every task for the semi-join up to this many (8 bytes each); beyond, the phrases are shuffled to them.
BROADCAST_KEYS = 1_000_000
#: Keys are counted in ranges; a range holds about this many phrase occurrences at most, so the ranges grow with the corpus.
RANGE_KEYS = 1 << 21

BREAK = b"\xff"  # in no UTF-8 text
_FOLD = bytearray(range(256))
_FOLD[ord("A"):ord("Z") + 1] = b"abcdefghijklmnopqrstuvwxyz"
for _byte in b".,;:!?\n\x0b\x0c\r":
    _FOLD[_byte] = BREAK[0]
_FOLD[ord("\t")] = ord(" ")
_FOLD = bytes(_FOLD)

#: One sorted relation: occurrence i stands ``step[i]`` places after the one before it and is phrase ``item[i]``, which
#: has the words ``tuples[item * k : item * k + k]`` of ``words`` and comes ``counts[item]`` times. ``n`` is
#: the number of occurrences. Numbers and words are compressed a value at a time, and files are written without compression, so that a
#: file takes hardly more memory than disk.
_RELATION = "lang string, step binary, item binary, tuples binary, counts binary, words binary, n long"
_NAMES = ["lang", "step", "item", "tuples", "counts", "words", "n"]
#: Bytes of stored relations that are unpacked at a time (one relation at least).
PACKED_BYTES = 1 << 20


def _planes(numbers: np.ndarray) -> bytes:
    """The width of one number, then all lowest bytes, all second ones and so on: high bytes are mostly zero and compress well."""
    kind = np.min_scalar_type(int(numbers.max())) if len(numbers) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + numbers.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()


def _from_planes(data: bytes | pa.Buffer) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(np.frombuffer(data, np.uint8, 1)[0], -1)
    return np.ascontiguousarray(planes.T).view(f"u{len(planes)}").ravel().astype(np.int64)


def _squeezed(data: bytes) -> bytes:
    """The number of bytes, in 8 bytes, then the bytes compressed."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _loosened(value: pa.Scalar) -> pa.Buffer:
    data = value.as_buffer()
    return pa.decompress(data.slice(8), int.from_bytes(data.slice(0, 8).to_pybytes(), "little"), "zstd")


def _packed(numbers: np.ndarray) -> bytes:
    """Compressed planes: steps are mostly 1, and words that come early, as frequent ones do, have low numbers."""
    return _squeezed(_planes(numbers))


def _unpacked(value: pa.Scalar) -> np.ndarray:
    return _from_planes(_loosened(value))


def _word_list(value: pa.Scalar) -> pa.Array:
    return pa.array(_loosened(value).to_pybytes().split(b" "), pa.binary()).cast(pa.string())


class _Codes(dict):
    """A number for every word, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


def _coded(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """(code of every word in order, with 0 between pieces; the words by code)."""
    codes = _Codes({BREAK: 0})
    data = BREAK.join(texts).translate(_FOLD).replace(BREAK, b" " + BREAK + b" ")
    out, at = [], 0
    while at < len(data):
        end = data.find(b" ", at + SEGMENT_BYTES)
        end = len(data) if end < 0 else end
        out.append(np.fromiter(map(codes.__getitem__, data[at:end].split()), np.int32))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.int32), list(codes)


def _relation(lang: str, at: np.ndarray, item: np.ndarray, tuples: np.ndarray, counts: np.ndarray, words: list[bytes]) -> list:
    return [lang, _packed(np.diff(at, prepend=0)), _packed(item), _packed(tuples.ravel()), _packed(counts), _squeezed(b" ".join(words)), len(at)]


def _batch(rows: list[list]) -> pa.RecordBatch:
    lang, *blobs, n = zip(*rows) if rows else [()] * len(_NAMES)
    columns = [pa.array(lang, pa.string()), *[pa.array(b, pa.binary()) for b in blobs], pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def occurrences(docs: DataFrame) -> DataFrame:
    """The first relation: every word of every whole text, a row per language and ``RELATION_BYTES`` of texts.

    Places are numbered through; the end of a piece takes one place, so neighbouring places are in one piece.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            by_lang.setdefault(lang, []).append(text)
        rows = []
        for lang, texts in by_lang.items():
            codes, words = _coded(texts)
            at = np.flatnonzero(codes)
            if len(at):
                n = len(words) - 1
                rows.append(_relation(lang, at, codes[at] - 1, np.arange(n), np.bincount(codes[at] - 1, minlength=n), words[1:]))
        return _batch(rows)

    return by_batch(docs.select(F.coalesce("lang", F.lit("und")), whole("text")), run, _RELATION, RELATION_BYTES)


def _keys(lang: str, tuples: np.ndarray, words: pa.Array) -> np.ndarray:
    """A 64-bit key per phrase from the hashes of its language and words."""
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()], np.uint64)
    key = np.full(len(tuples), xxhash.xxh64_intdigest(lang), np.uint64)
    for column in tuples.T:
        key = (key + hashes[column]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _leading(keys: np.ndarray, bits: int) -> np.ndarray:
    """The first ``bits`` bits of every key."""
    return (keys.view(np.uint64) >> np.uint64(64 - bits)).view(np.int64)


_READ = ["lang", "step", "item", "tuples", "counts", "words"]


def _candidates(batch: pa.RecordBatch, row: int, size: int, joined: bool) -> tuple:
    """(lang, places, items, tuples, counts, words) of one relation of ``size`` words.

    With ``joined`` the row holds phrases one word shorter, and two of them at neighbouring places of one piece make one.
    """
    step, item, tuples, counts = (_unpacked(batch.column(c)[row]) for c in (1, 2, 3, 4))
    lang, at, words = batch.column(0)[row].as_py(), np.cumsum(step), _word_list(batch.column(5)[row])
    tuples = tuples.reshape(-1, size - joined)
    if joined:  # the merge-join: both sides are this sorted relation
        left = np.flatnonzero(np.diff(at) == 1)
        pairs, items, counts = np.unique(item[left] * len(tuples) + item[left + 1], return_inverse=True, return_counts=True)
        at, item = at[left], items
        tuples = np.column_stack([tuples[pairs // max(len(tuples), 1)], tuples[pairs % max(len(tuples), 1), -1:]])
    return lang, at, item, tuples, counts, words


def _groups(relations: DataFrame, size: int, bits: int) -> DataFrame:
    """(chunk, item, key): the phrases of every relation."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        chunks, items, keys = [], [], []
        for row, (chunk, lang) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            tuples = _unpacked(batch.column(2)[row]).reshape(-1, size)
            chunks.append(np.full(len(tuples), chunk, np.int64))
            items.append(np.arange(len(tuples), dtype=np.int32))
            keys.append(_leading(_keys(lang, tuples, _word_list(batch.column(3)[row])), bits))
        columns = [pa.array(np.concatenate(x) if x else np.empty(0, k)) for x, k in ((chunks, np.int64), (items, np.int32), (keys, np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "item", "key"])

    return by_batch(relations.select("chunk", "lang", "tuples", "words"), run, "chunk long, item int, key long", PACKED_BYTES)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _frequent_keys(relations: DataFrame, size: int, joined: bool, least: int, bits: int, range_bits: int) -> DataFrame:
    """(key): keys of ``bits`` bits of the candidates that come at least ``least`` times.

    A batch sends its sorted distinct keys as differences, a row per range of keys: two or three bytes a key instead of
    a row each. Ranges are merged one at a time, so a task holds the distinct keys of one range, however many it gets.
    """

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for row in range(batch.num_rows):
            lang, _, _, tuples, times, words = _candidates(batch, row, size, joined)
            keys.append(_leading(_keys(lang, tuples, words), bits))
            counts.append(times)
        key, n = _summed(np.concatenate(keys), np.concatenate(counts))
        ranges, starts = np.unique(key >> (bits - range_bits), return_index=True)
        ends = [*starts[1:], len(key)]
        packed = [(_planes(np.diff(key[a:b], prepend=r << (bits - range_bits))), _planes(n[a:b])) for r, a, b in zip(ranges.tolist(), starts, ends)]
        columns = [pa.array(ranges, pa.int64()), pa.array([k for k, _ in packed], pa.binary()), pa.array([c for _, c in packed], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["part", "keys", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts, held, limit = None, [], [], 0, RANGE_KEYS

        def passing() -> pa.RecordBatch:
            key, n = _summed(np.concatenate(keys), np.concatenate(counts))
            return pa.RecordBatch.from_arrays([pa.array(key[n >= least])], ["key"])

        for batch in batches:
            for row, part in enumerate(batch.column(0).to_pylist()):
                if part != now:
                    if keys:
                        yield passing()
                    now, keys, counts, held, limit = part, [], [], 0, RANGE_KEYS
                steps = _from_planes(batch.column(1)[row].as_py())
                keys.append(np.cumsum(steps) + (part << (bits - range_bits)))
                counts.append(_from_planes(batch.column(2)[row].as_py()))
                held += len(steps)
                if held > limit:
                    key, n = _summed(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, held, limit = [key], [n], len(key), max(RANGE_KEYS, 2 * len(key))
        if keys:
            yield passing()

    packed = by_batch(relations.select(*_READ), pack, "part long, keys binary, counts binary", PACKED_BYTES)
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "key long")


def _joined(relations: DataFrame, size: int) -> DataFrame:
    """All candidates of ``size`` words as relations."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for row in range(batch.num_rows):
            lang, at, item, tuples, counts, words = _candidates(batch, row, size, True)
            if len(at):
                rows.append(_relation(lang, at, item, tuples, counts, words.cast(pa.binary()).to_pylist()))
        return _batch(rows)

    return by_batch(relations.select(*_READ), run, _RELATION, PACKED_BYTES)


def _passed(relations: DataFrame, often: DataFrame, size: int, joined: bool, longest: int, bits: int) -> DataFrame:
    """The relation of the candidates of ``size`` words with a key in ``often``; of the longest only phrases and counts."""
    keys, columns = None, _READ
    if often.count() <= BROADCAST_KEYS:
        keys = np.sort(often.toArrow().column("key").to_numpy())
    else:
        if joined:  # both sides of the join must see the same rows
            relations, joined = _stored(_joined(relations, size), size), False
        kept = _groups(relations, size, bits).join(often, "key", "left_semi").groupBy("chunk").agg(F.collect_list("item").alias("kept"))
        relations, columns = relations.join(kept, "chunk"), [*columns, "kept"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for row in range(batch.num_rows):
            lang, at, item, tuples, counts, words = _candidates(batch, row, size, joined)
            if keys is None:
                keep = np.sort(batch.column(6)[row].values.to_numpy(zero_copy_only=False))
            else:
                own = _leading(_keys(lang, tuples, words), bits)
                keep = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own) if len(keys) else np.empty(0, np.int64)
            if not len(keep):
                continue
            tuples, counts = tuples[keep], counts[keep]
            place = np.full(int(item.max()) + 1, -1, np.int64)
            place[keep] = np.arange(len(keep))
            item = place[item]
            stays = np.flatnonzero(item >= 0) if size < longest else np.empty(0, np.int64)
            used, codes = np.unique(tuples, return_inverse=True)
            rows.append(_relation(lang, at[stays], item[stays], codes, counts, words.take(pa.array(used)).cast(pa.binary()).to_pylist()))
        return _batch(rows)

    return by_batch(relations.select(*columns), run, _RELATION, PACKED_BYTES)


def _counted(relations: DataFrame, size: int, least: int, range_bits: int) -> DataFrame:
    """(lang, phrase, f): the phrases of the relations that come at least ``least`` times.

    A relation sends its phrases sorted and compressed, a row per range of keys, and not a row each. Ranges are
    merged one at a time: a task holds the distinct phrases of one language and range.
    """

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for row, lang in enumerate(batch.column(0).to_pylist()):
            tuples, counts = _unpacked(batch.column(1)[row]).reshape(-1, size), _unpacked(batch.column(2)[row])
            words = _word_list(batch.column(3)[row])
            part = _leading(_keys(lang, tuples, words), range_bits) if range_bits else np.zeros(len(tuples), np.int64)
            phrases = pc.binary_join_element_wise(*[words.take(pa.array(c)) for c in tuples.T], " ")
            order = pc.sort_indices(pa.table({"part": part, "phrase": phrases}), [("part", "ascending"), ("phrase", "ascending")]).to_numpy()
            part, counts, phrases = part[order], counts[order], phrases.take(pa.array(order))
            ranges, starts = np.unique(part, return_index=True)
            for r, a, b in zip(ranges.tolist(), starts.tolist(), [*starts[1:].tolist(), len(part)]):
                text = "\n".join(phrases.slice(a, b - a).to_pylist()).encode()  # no word holds a line end
                rows.append((lang, r, len(text), pa.compress(text, "zstd", asbytes=True), _planes(counts[a:b])))
        columns = list(zip(*rows)) if rows else [()] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "part", "bytes", "phrases", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, limit, kept = None, 0, RANGE_KEYS, []

        def summed() -> pa.Table:
            return pa.concat_tables(kept).group_by("phrase").aggregate([("f", "sum")]).rename_columns({"f_sum": "f"}).select(["phrase", "f"])

        def passing() -> list[pa.RecordBatch]:
            found = summed()
            found = found.filter(pc.greater_equal(found["f"], least))
            return found.add_column(0, "lang", pa.repeat(pa.scalar(now[1], pa.string()), len(found))).to_batches()

        for batch in batches:
            for row, key in enumerate(zip(batch.column(1).to_pylist(), batch.column(0).to_pylist())):
                if key != now:
                    if kept:
                        yield from passing()
                    now, held, limit, kept = key, 0, RANGE_KEYS, []
                text = pa.decompress(batch.column(3)[row].as_py(), batch.column(2)[row].as_py(), "zstd", asbytes=True)
                phrases = pa.array(text.decode().split("\n"), pa.string())
                kept.append(pa.table({"phrase": phrases, "f": _from_planes(batch.column(4)[row].as_py())}))
                held += len(phrases)
                if held > limit:
                    kept = [summed()]
                    held = len(kept[0])
                    limit = max(RANGE_KEYS, 2 * held)
        if kept:
            yield from passing()

    packed = by_batch(relations.select("lang", "tuples", "counts", "words"), pack, "lang string, part long, bytes long, phrases binary, counts binary", PACKED_BYTES)
    return packed.repartition("part", "lang").sortWithinPartitions("part", "lang").mapInArrow(merge, "lang string, phrase string, f long")


def _stored(relations: DataFrame, size: int) -> DataFrame:
    """The relations in the shared folder, each with a number; uncompressed."""
    path = work_path(relations.sparkSession, f"occurrences-{size}")
    relations.withColumn("chunk", F.monotonically_increasing_id()).write.option("compression", "none").parquet(path)
    return relations.sparkSession.read.parquet(path)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT) -> tuple[DataFrame, DataFrame]:
    """((lang, size, phrase, f) of all phrases with at least ``least`` occurrences; (lang, n) with all words counted).

    Level by level, the stored k-word occurrences meet at neighbouring places, which gives the candidates one word
    longer; these are grouped and counted, and those below ``least`` leave by a semi-join before the relation is
    stored. Candidates are made twice, once to count and once to keep, and not stored, as most of them are rare. The
    semi-join goes by hash keys summed over the corpus, with at least 16 values per occurrence: a collision lets a rare
    phrase pass to the next level and no more, since the result counts the phrases themselves (:func:`_counted`). Only phrases, never
    their occurrences, are shuffled by key; a very common one comes once per batch at most. Above ``BROADCAST_KEYS``
    frequent keys the candidates are stored, numbered and joined with them.
    """
    with shuffles_freed(docs.sparkSession):
        relations = _stored(occurrences(docs), 0)
        totals = written(relations.groupBy("lang").agg(F.sum("n").alias("n")), "words-by-language")
        found = []
        for size in range(1, longest + 1):
            joined = size > 1
            occurring = relations.agg(F.sum("n")).first()[0] or 0
            range_bits = (occurring // RANGE_KEYS).bit_length()
            bits = min(62, max(occurring.bit_length() + 4, range_bits + 8))
            often = written(_frequent_keys(relations, size, joined, least, bits, range_bits), "frequent-keys")
            shorter, relations = relations, _stored(_passed(relations, often, size, joined, longest, bits), size)
            discard(shorter)
            counted = _counted(relations, size, least, max(range_bits - 2, 0))
            found.append(written(counted.select("lang", F.lit(size).alias("size"), "phrase", "f"), f"phrases-{size}"))
        discard(relations)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, totals


def _words_of(words: Column, start: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT, per_lang: int = PER_LANG, covered: int = COVERED_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``per_lang`` phrases of 2 to ``longest`` words.

    A phrase occurs ``a`` times, the two sides of its weakest cut ``l`` and ``r`` times, and its language has ``n``
    words; ``score`` is floor(2000000 a / (l + r)). Phrases that a longer candidate covers to ``covered`` percent are
    left out. A null text is empty, a null lang is ``und``; repeated rows and rows without an id count as they come;
    other columns are ignored; an empty table, or one without frequent phrases, gives an empty result. Texts of any
    length are read whole, in memory of a few times the text.
    """
    phrases, totals = frequent_phrases(docs, longest, least)
    split = F.split("phrase", " ", -1)
    candidates = phrases.where(F.col("size") > 1).select("lang", "size", "phrase", F.col("f").alias("a"), split.alias("w"))
    inside = candidates.where(F.col("size") > 2).select("lang", "a", "w", F.explode(F.expr(
        "flatten(transform(sequence(2, size - 1), s -> transform(sequence(1, size - s + 1), i -> struct(i, s))))")).alias("x"))
    inside = inside.groupBy("lang", _words_of(F.col("w"), F.col("x.i"), F.col("x.s")).alias("phrase")).agg(F.max("a").alias("around"))
    left = candidates.join(inside, ["lang", "phrase"], "left").where(
        F.coalesce(F.col("around").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * covered, F.lit(True)))
    cuts = left.select("lang", "phrase", "a", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _words_of(F.col("w"), 1, F.col("k")).alias("first"), _words_of(F.col("w"), F.col("k") + 1, F.col("size")).alias("rest"))
    side = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    scored = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).withColumn(
        "score", F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").cast("long"))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_lang)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocation_sql(longest: int = LONGEST, least: int = LEAST_COUNT, per_lang: int = PER_LANG, covered: int = COVERED_PERCENT) -> str:
    """The same rows in DuckDB SQL."""
    return f"""
WITH pieces AS (
 SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
 worded AS (SELECT lang, [w FOR w IN string_split_regex(piece, '[\\x20\\x09]+') IF w <> ''] AS w FROM pieces),
 totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
 sized AS (SELECT lang, w, unnest(range(1, {longest + 1})) AS size FROM worded),
 placed AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized),
 grams AS MATERIALIZED (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f FROM placed GROUP BY ALL HAVING count(*) >= {least}),
 cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE size > 1),
 subs AS (SELECT lang, a, w, size, unnest(range(2, size)) AS s FROM cand WHERE size > 2),
 parts AS (SELECT lang, a, w, s, unnest(range(1, size - s + 2)) AS i FROM subs),
 around AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS around FROM parts GROUP BY ALL),
 stay AS (SELECT cand.* FROM cand LEFT JOIN around USING (lang, phrase) WHERE around IS NULL OR 100 * around < {covered} * a),
 cuts AS (SELECT lang, phrase, a, w, size, unnest(range(1, size)) AS k FROM stay),
 scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score FROM cuts c
  JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:c.size], ' ')),
 weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {per_lang}"""
