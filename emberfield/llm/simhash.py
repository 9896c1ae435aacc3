"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary-trie self-join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .components import components
from .exact import content_digest
from .texts import by_batch, strings, whole

SHINGLE = 3
HASH_SEED = 42
MOST_BITS = 2
#: Fingerprints that one task walks at once; larger groups fall into pairs of trie nodes.
GROUP_ROWS = 20_000
#: Node pairs of at most so many fingerprint pairs are compared directly.
LEAF_PAIRS = 4096
#: Hashes whose bits are counted at once.
_CHUNK = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits: bit set where over half of the shingle hashes have it; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    last = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    h = xxhash.xxh64_intdigest
    for start in range(0, last, _CHUNK):
        stop = min(last, start + _CHUNK)
        hashes = [h(b" ".join(words[i:i + shingle]), HASH_SEED) for i in range(start, stop)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as the bits of a long; with ``digest`` also the text's hash."""
    more = [content_digest(whole("text")).alias("digest")] if digest else []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in strings(batch.column(1))], np.uint64)
        columns = [batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", *batch.schema.names[2:]])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, fp long" + (", digest binary" if digest else "")
    return by_batch(docs.select("doc_id", "text", *more), run, schema)


# --- the trie ----------------------------------------------------------------------------------------------------


def _halves(keys: np.ndarray, lo: int, hi: int, bit: int) -> int:
    """Where, in the sorted range of keys that agree on all higher bits, the ones of this bit begin."""
    top = int(keys[lo]) >> (bit + 1) << (bit + 1) | 1 << bit
    return lo + int(np.searchsorted(keys[lo:hi], np.uint64(top)))


def trie_links(a: np.ndarray, b: np.ndarray | None = None, most: int = MOST_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of values with 1 to ``most`` differing bits, between sorted arrays or within one (``b`` None).

    Both tries are walked together from the highest bit. A node is a range of the sorted values; a pair of nodes
    carries the number of bits that differ so far and is left as soon as that exceeds ``most``. Small pairs are
    compared directly.
    """
    same = b is None
    b = a if same else b
    stack = [(0, len(a), 0, len(b), 63, 0)] if len(a) and len(b) else []
    while stack:
        i, j, k, m, bit, off = stack.pop()
        own = same and i == k
        if (j - i) * (m - k) <= LEAF_PAIRS or bit < 0:
            differ = np.bitwise_count(a[i:j, None] ^ b[None, k:m])
            hit = (differ <= most) & (differ > 0)
            x, y = np.nonzero(np.triu(hit, 1) if own else hit)
            if len(x):
                yield a[i + x], b[k + y]
            continue
        p, q = _halves(a, i, j, bit), _halves(b, k, m, bit)
        for ai, aj, bk, bm, step in ((i, p, k, q, 0), (p, j, q, m, 0), (i, p, q, m, 1), (p, j, k, q, 1)):
            if own and ai > bk:  # the mirror image of a pair already taken
                continue
            if ai < aj and bk < bm and off + step <= most:
                stack.append((ai, aj, bk, bm, bit - 1, off + step))


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Links that join the same values as the pairs do, one fewer than values per tree."""
    parent: dict[int, int] = {}
    out = []

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for xs, ys in pairs:
        for x, y in zip(xs.tolist(), ys.tolist()):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((x, y))
    return out


# --- distribution ------------------------------------------------------------------------------------------------


def _blocks() -> list[tuple[int, int]]:
    """Pairs out of four 16-bit blocks: with two errors, at least two blocks stay equal."""
    return list(combinations(range(4), 2))


def _placed(fps: DataFrame) -> DataFrame:
    """(band, value, path, side, cross, off, fp): fp once per pair of blocks, under the value of these blocks.

    ``path`` names the pair of trie nodes reached so far, ``side`` the node of the pair that holds fp, ``cross`` whether
    the two nodes differ, ``off`` by how many bits.
    """
    part = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    keys = [
        F.struct(F.lit(n).alias("band"), (part(i) * 65536 + part(j)).alias("value")) for n, (i, j) in enumerate(_blocks())
    ]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp").select(
        "key.band", "key.value", F.lit("").alias("path"), F.lit(0).alias("side"), F.lit(False).alias("cross"),
        F.lit(0).alias("off"), "fp",
    )


def _rest(depth: int) -> Column:
    """The next 8 bits of fp, at the given depth, outside the blocks that the band holds equal."""
    choices = []
    for i, j in _blocks():
        free = [x for x in (3, 2, 1, 0) if x not in (i, j)]
        bits = 16 * free[depth // 2] + (8 if depth % 2 == 0 else 0)
        choices.append(F.shiftrightunsigned("fp", bits).bitwiseAND(F.lit(0xFF)).cast("int"))
    return F.element_at(F.array(*choices), F.col("band") + 1)


def linked(fps: DataFrame, most: int = MOST_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(u, v): links between distinct fingerprints ``fp`` with at most ``most`` (2) differing bits.

    They have the same components as all such pairs; within a group only a forest is written. Two fingerprints with
    two errors agree in two of four blocks, so every pair meets in a group of equal block values. A task walks a
    group's trie with itself. A group above ``group_rows`` is first dealt out by pairs of trie nodes, 8 levels at a
    time: a fingerprint goes to each node pair of which its own node is one and whose labels differ in at most
    ``most`` bits. No group's pairs are listed.
    """
    if most > MOST_BITS:
        raise ValueError("four blocks find pairs with up to two differing bits")
    rows = _placed(fps)
    found = None
    for depth in range(5):
        sizes = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.min("side").alias("s"), F.max("side").alias("t"))
        sizes = sizes.where("n > 1").select(*_KEY, "n", (F.col("s") < F.col("t")).alias("both"))
        rows = written(rows.join(sizes, _KEY).where("both or not cross").drop("both"), "simhash-groups")
        small = rows.where(F.col("n") <= group_rows) if depth < 4 else rows
        links = _walk(small.drop("n"), most)
        found = links if found is None else found.unionByName(links)
        large = rows.where(F.col("n") > group_rows)
        if depth == 4 or large.isEmpty():
            break
        rows = _deeper(large, depth, most)
    return found


_KEY = ["band", "value", "path"]


def _deeper(rows: DataFrame, depth: int, most: int) -> DataFrame:
    """Every fingerprint under the node pairs, 8 levels further down, whose labels differ in few enough bits."""
    own, step = F.col("own"), F.array(*[F.lit(x) for x in range(256) if x.bit_count() <= most])

    def child(x: Column) -> Column:
        other = own.bitwiseXOR(x)
        first = F.when(F.col("cross"), F.col("side") == 0).otherwise(own <= other)
        label = F.when(first, F.format_string("/%d-%d", own, other)).otherwise(F.format_string("/%d-%d", other, own))
        return F.struct(
            F.concat("path", label).alias("path"), F.when(first, 0).otherwise(1).alias("side"),
            (F.col("cross") | (x != 0)).alias("cross"), (F.col("off") + F.bit_count(x)).alias("off"),
        )

    children = F.filter(F.transform(step, child), lambda c: c["off"] <= most)
    return rows.withColumn("own", _rest(depth)).select("band", "value", F.explode(children).alias("c"), "fp").select(
        "band", "value", "c.path", "c.side", "c.cross", "c.off", "fp"
    )


def _walk(rows: DataFrame, most: int) -> DataFrame:
    """Links inside the groups: a group lies in one partition, its rows side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held = None, []

        def flush() -> list[tuple[int, int]]:
            if not held:
                return []
            fps, sides, crossed = (np.concatenate(x) for x in zip(*held))
            if crossed[0]:
                return forest(trie_links(np.unique(fps[sides == 0]), np.unique(fps[sides == 1]), most))
            return forest(trie_links(np.unique(fps), most=most))

        def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            band, value = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            path = np.array(batch.column(2).to_pylist(), object)
            side, crossed, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
            fp = fp.view(np.uint64)
            new = np.flatnonzero((band[1:] != band[:-1]) | (value[1:] != value[:-1]) | (path[1:] != path[:-1])) + 1
            links = []
            for lo, hi in zip([0, *new], [*new, len(fp)]):
                this = (band[lo], value[lo], path[lo])
                if this != open_key:
                    links += flush()
                    open_key, held = this, []
                held.append((fp[lo:hi], side[lo:hi], crossed[lo:hi]))
            if links:
                yield batch_of(links)
        if last := flush():
            yield batch_of(last)

    rows = rows.repartition(*_KEY).sortWithinPartitions(*_KEY)
    return rows.select(*_KEY, "side", "cross", "fp").mapInArrow(run, "u long, v long")


def near_groups(docs: DataFrame, most: int = MOST_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``.

    Whole texts, A-Z lower-cased; three-word shingles, repeats included; a text with fewer words is one shingle, one
    without words (null, empty) has fingerprint zero and is linked like any other. Fingerprints link at ``most`` or
    fewer differing bits; component_id is the smallest doc_id reachable. A null doc_id never names a group unless all
    its ids are null. Repeated rows fall into one group. Other columns are ignored; an empty table gives an empty
    result.

    Only distinct fingerprints are compared, so copies cost one row each.
    """
    rows = written(fingerprints(docs), "simhash-fingerprints")
    return rows.join(_components_of(rows, most, group_rows), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _components_of(rows: DataFrame, most: int, group_rows: int) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints among ``rows`` (doc_id, fp)."""
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    roots = components(linked(distinct.select("fp"), most, group_rows))
    named = roots.join(distinct, roots["node"] == distinct["fp"]).select("fp", "root", "least_id")
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return distinct.join(named.select("fp", "root").join(ids, "root").drop("root"), "fp", "left").select(
        "fp", F.coalesce("component_id", "least_id").alias("component_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the near copies: of each group the document with the smallest doc_id stays.

    Every row is judged by its id and its text, so an id that comes with several texts loses only those that are
    copies. Rows of a group that share its smallest doc_id all stay; rows without an id stay only in groups where no
    row has one.
    """
    rows = written(fingerprints(docs, digest=True), "simhash-fingerprints")
    gone = rows.join(_components_of(rows, MOST_BITS, GROUP_ROWS), "fp").where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (content_digest(whole("text")) == F.col("gone_digest"))
    return docs.join(gone, same, "left_anti")
