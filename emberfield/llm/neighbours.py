"""Approximate nearest neighbours: a vantage-point tree per shard, with triangle-inequality pruning relaxed by a factor.

Nearness is the inner product. Vectors get one more component, sqrt(M^2 - |x|^2) with M the greatest length, and
queries get 0 there; the Euclidean distance between them then falls as the inner product grows, and obeys the triangle
inequality that the trees need.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import written
from .codes import finite, matrix
from .texts import bounded_sample

NEIGHBOURS = 20
#: A subtree or shard is left out if its distance bound times this exceeds the k-th best distance; 1 is exact.
RELAX = 1.15
#: Vectors of one shard, of one bucket of its tree, queries searched together.
SHARD_ROWS = 4096
BUCKET_ROWS = 64
QUERY_BLOCK = 1024
#: The shard boundaries are fitted on this many vectors at most, and there are at most so many regions; a region with
#: more rows than a shard holds is dealt over several shards.
SAMPLE_ROWS = 16_384
MAX_REGIONS = 1024
#: Share of the greatest length by which bounds give way to rounding.
SLACK = 1e-6
SEED = 13


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, added component after component: the same for a pair wherever it is computed."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _lifted(vectors: np.ndarray, greatest: float) -> np.ndarray:
    """Vectors with the component that makes them equally long."""
    return np.column_stack([vectors, np.sqrt(np.maximum(greatest - (vectors * vectors).sum(1), 0.0))])


def _query_points(vectors: np.ndarray) -> np.ndarray:
    return np.column_stack([vectors, np.zeros(len(vectors))])


def _distances(points: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - point) ** 2).sum(1))


def _vantage(points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Of a few points the one whose distances to a few others spread most."""
    few = points[rng.permutation(len(points))[:8]]
    probe = points[rng.permutation(len(points))[:64]]
    return few[int(np.argmax([_distances(probe, p).var() for p in few]))]


@dataclass
class Regions:
    """A vantage-point tree of fixed depth over a sample; its leaves are the regions that rows are dealt to."""

    vantage: np.ndarray
    median: np.ndarray
    depth: int

    @classmethod
    def fit(cls, points: np.ndarray, regions: int) -> Regions:
        depth = max(0, regions - 1).bit_length()
        rng = np.random.default_rng(SEED)
        vantage, median = np.zeros(((1 << depth) - 1, points.shape[1])), np.zeros((1 << depth) - 1)
        held = {0: points}
        for node in range((1 << depth) - 1):
            own = held.pop(node)
            if len(own):
                vantage[node] = _vantage(own, rng)
                away = _distances(own, vantage[node])
                median[node] = np.median(away)
                held[2 * node + 1], held[2 * node + 2] = own[away <= median[node]], own[away > median[node]]
            else:
                held[2 * node + 1] = held[2 * node + 2] = own
        return cls(vantage, median, depth)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The region of every point."""
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            outside = np.sqrt(((points - self.vantage[node]) ** 2).sum(1)) > self.median[node]
            node = 2 * node + 1 + outside
        return node - ((1 << self.depth) - 1)

    def bounds(self, points: np.ndarray) -> np.ndarray:
        """(points, regions): no row of a region is nearer to the point than this."""
        least = np.zeros((len(points), 1))
        for level in range(self.depth):
            nodes = slice((1 << level) - 1, (2 << level) - 1)
            away = np.sqrt(np.maximum(((points[:, None, :] - self.vantage[None, nodes]) ** 2).sum(2), 0.0)) - self.median[nodes]
            least = np.stack([np.maximum(least, away), np.maximum(least, -away)], 2).reshape(len(points), -1)
        return least


class Tree:
    """A vantage-point tree over one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, greatest: float) -> None:
        self.ids, self.vectors, self.points = ids, vectors, _lifted(vectors, greatest)
        self.root = self._node(np.arange(len(ids)), np.random.default_rng(SEED))

    def _node(self, rows: np.ndarray, rng: np.random.Generator):
        if len(rows) <= BUCKET_ROWS:
            return rows
        own = self.points[rows]
        vantage = _vantage(own, rng)
        away = _distances(own, vantage)
        inside = away <= np.median(away)
        if inside.all():  # many copies of one vector: no distance tells them apart
            half = len(rows) // 2
            inside = np.arange(len(rows)) < half
        return (vantage, away[inside].max(), away[~inside].min(), self._node(rows[inside], rng), self._node(rows[~inside], rng))


class Search:
    """The best ``k`` of one tree for a block of queries, in place; ``least`` holds scores already reached elsewhere."""

    def __init__(self, tree: Tree, ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int, relax: float, greatest: float) -> None:
        self.tree, self.query_ids, self.queries, self.least, self.relax = tree, ids, queries, least, relax
        self.points = _query_points(queries)
        self.reach = (queries * queries).sum(1) + greatest  # squared distance of a vector with product 0
        self.slack = SLACK * np.sqrt(self.reach)
        self.scores, self.found = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.visit(tree.root, np.arange(len(ids)))

    def radius(self, active: np.ndarray) -> np.ndarray:
        """How far a subtree may be: the k-th best distance, relaxed."""
        kth = np.maximum(self.scores[active, -1], self.least[active])
        return np.sqrt(np.maximum(self.reach[active] - 2 * kth, 0.0)) / self.relax + self.slack[active]

    def visit(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if not isinstance(node, tuple):
            return self.score(node, active)
        vantage, innermost, outermost, inner, outer = node
        away = _distances(self.points[active], vantage)
        first = away <= (innermost + outermost) / 2
        self.visit(inner, active[first & (away - innermost <= self.radius(active))])
        self.visit(outer, active[outermost - away <= self.radius(active)])
        self.visit(inner, active[~first & (away - innermost <= self.radius(active))])

    def score(self, rows: np.ndarray, active: np.ndarray) -> None:
        tree = self.tree
        about = self.queries[active] @ tree.vectors[rows].T
        wanted = about >= (np.maximum(self.scores[active, -1], self.least[active]) - self.slack[active] * np.sqrt(self.reach[active]))[:, None]
        same = self.query_ids[active][:, None] == tree.ids[rows][None, :]
        for q, r in zip(*np.nonzero(same & wanted)):
            wanted[q, r] = not np.array_equal(self.queries[active[q]], tree.vectors[rows[r]])
        q, r = np.nonzero(wanted)
        if not len(q):
            return
        exact = _products(self.queries[active[q]], tree.vectors[rows[r]])
        changed, row = np.unique(q, return_inverse=True)
        column = np.arange(len(q)) - np.searchsorted(q, changed)[row]
        k = self.scores.shape[1]
        scores = np.full((len(changed), k + column.max() + 1), -np.inf)
        ids = np.full(scores.shape, np.iinfo(np.int64).max)
        at = active[changed]
        scores[:, :k], ids[:, :k] = self.scores[at], self.found[at]
        scores[row, k + column], ids[row, k + column] = exact, tree.ids[rows[r]]
        order = np.lexsort((ids, -scores), axis=1)[:, :k]
        self.scores[at], self.found[at] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _usable(vectors: DataFrame, vector: str) -> DataFrame:
    fine = vectors.where(F.col("vec_id").isNotNull() & finite(vector)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    return fine.where(F.exists("vector", lambda x: x != 0))


@dataclass
class Index:
    """Every usable vector in a stored table (region, shard, vec_id, vector), and how regions are found."""

    rows: DataFrame
    shards: dict[int, int]
    regions: Regions
    width: int
    greatest: float

    def search(self, queries: DataFrame, vector: str = "embedding", k: int = NEIGHBOURS, relax: float = RELAX) -> DataFrame:
        """query_id, rank, vec_id, score: each query's ``k`` rows of largest inner product found, ties to the smaller id.

        Queries look into one shard of their own region first; the distance reached there tells which other regions
        can hold something better, and only these are visited. A query row never finds itself (same id, same vector).
        ``relax`` 1 finds the very nearest; more skips what can only be little better.
        """
        asked = _usable(queries, vector).withColumn("twin", F.xxhash64("vector")).dropDuplicates(["vec_id", "twin", "vector"])
        asked = written(asked.withColumnsRenamed({"vec_id": "query_id"}), "queries")
        home = written(self._found(self._dealt(asked, relax, None), k, relax), "neighbours-near")
        key = ["query_id", "twin"]
        reached = home.groupBy(*key).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).select(*key, F.when(F.col("n") >= k, F.col("least")).alias("least"))
        more = asked.join(reached, key, "left")
        rest = written(self._found(self._dealt(more, relax, "least"), k, relax), "neighbours-far")
        order = W.partitionBy(*key).orderBy(F.desc("score"), "vec_id")
        ranked = home.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select("query_id", "rank", "vec_id", "score")

    def _dealt(self, asked: DataFrame, relax: float, least: str | None) -> DataFrame:
        """(region, shard, query_id, twin, least, vector): the shards that every query visits.

        Without ``least`` this is one shard of the query's region; with it, all others within reach of that score.
        """
        regions, width, greatest, shards = self.regions, self.width, self.greatest, self.shards
        many = np.array([shards.get(r, 0) for r in range(1 << regions.depth)], np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole_batch in batches:
                for start in range(0, whole_batch.num_rows, 256):
                    batch = whole_batch.slice(start, 256)
                    points = _query_points(matrix(batch.column(3), width))
                    twin = np.asarray(batch.column(1), np.int64)
                    bounds = regions.bounds(points)
                    full = np.where(many > 0, bounds, np.inf)
                    own = regions.of(points)
                    own = np.where(many[own] > 0, own, full.argmin(1))
                    own_shard = twin % np.maximum(many[own], 1)
                    if least is None:
                        row, region, shard = np.arange(len(points)), own, own_shard
                    else:
                        square = (points * points).sum(1) + greatest
                        score = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                        radius = np.sqrt(np.maximum(square - 2 * np.where(np.isnan(score), -np.inf, score), 0.0)) / relax + SLACK * np.sqrt(square)
                        row, region = np.nonzero(full <= np.minimum(radius, 1e300)[:, None])
                        times = many[region]
                        row, region = np.repeat(row, times), np.repeat(region, times)
                        shard = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                        other = (region != own[row]) | (shard != own_shard[row])
                        row, region, shard = row[other], region[other], shard[other]
                    for at in range(0, len(row), 4096):
                        part = slice(at, at + 4096)
                        taken = pa.array(row[part])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(region[part].astype(np.int32)), pa.array(shard[part].astype(np.int32)), *[c.take(taken) for c in batch.columns]],
                            ["region", "shard", "query_id", "twin", "least", "vector"])

        rows = asked.select("query_id", "twin", (F.col(least) if least else F.lit(None).cast("double")).alias("least"), "vector")
        return rows.mapInArrow(run, "region int, shard int, query_id long, twin long, least double, vector array<double>")

    def _found(self, dealt: DataFrame, k: int, relax: float) -> DataFrame:
        """(query_id, twin, vec_id, score): the best ``k`` per query and shard.

        A group is one shard and one block of its queries, so it stays small however many queries meet in a shard.
        """
        width, greatest = self.width, self.greatest
        dealt = written(dealt, "dealt-queries")
        key = ["region", "shard"]
        blocks = dealt.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
        left = self.rows.join(blocks, key).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        right = dealt.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("query_id", "twin"), F.col("blocks")).cast("int")).drop("blocks")

        def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
            ids, vectors = rows.column("vec_id").to_numpy(), matrix(rows.column("vector"), width)
            order = np.lexsort((*vectors.T[::-1], ids))
            ids, vectors = ids[order], vectors[order]
            fresh = np.ones(len(ids), bool)  # a repeated row is one row
            fresh[1:] = (ids[1:] != ids[:-1]) | (vectors[1:] != vectors[:-1]).any(1)
            least = asked.column("least").to_numpy().astype(float)
            query_ids = asked.column("query_id").to_numpy()
            done = Search(Tree(ids[fresh], vectors[fresh], greatest), query_ids, matrix(asked.column("vector"), width), np.where(np.isnan(least), -np.inf, least), k, relax, greatest)
            q, r = np.nonzero(np.isfinite(done.scores))
            return pa.table({"query_id": query_ids[q], "twin": asked.column("twin").to_numpy()[q], "vec_id": done.found[q, r], "score": done.scores[q, r]})

        group = [*key, "block"]
        return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(
            lambda rows, asked: run(rows, asked) if len(rows) and len(asked) else _NOTHING, "query_id long, twin long, vec_id long, score double")


_NOTHING = pa.table({"query_id": pa.array([], pa.int64()), "twin": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})


def build_index(vectors: DataFrame, vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> Index:
    """An index of every row with an id and a vector that is not null, not zero and without null or non-finite components.

    Region boundaries come from at most ``SAMPLE_ROWS`` vectors; every row is then sent to its region, and regions
    above ``shard_rows`` rows are dealt over shards by a hash of the id, so that no shard outgrows a task, not even
    where one vector makes up much of the table. Shorter vectors are filled with zeros to the longest. Repeated rows
    (same id and vector) are one row; an id with several vectors has several rows. An empty table gives an empty index.
    """
    rows = _usable(vectors, vector)
    square = F.aggregate("vector", F.lit(0.0), lambda x, y: x + y * y)
    n, width, greatest = rows.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(square)).first()
    width, greatest = width or 1, (greatest or 0.0) * (1 + 1e-12)
    wanted = min(MAX_REGIONS, max(1, -(-n // shard_rows)))
    sample = bounded_sample(rows, min(SAMPLE_ROWS, 64 * wanted), "vec_id", "vector").select("vector").collect() if wanted > 1 else []
    points = _lifted(matrix(pa.array([r["vector"] for r in sample], pa.list_(pa.float64())), width), greatest)
    regions = Regions.fit(points, wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                region = regions.of(_lifted(matrix(part.column(1), width), greatest))
                yield pa.RecordBatch.from_arrays([pa.array(region.astype(np.int32)), *part.columns], ["region", "vec_id", "vector"])

    placed = written(rows.mapInArrow(run, "region int, vec_id long, vector array<double>"), "vectors-by-region")
    counts = {r["region"]: r["n"] for r in placed.groupBy("region").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MAX_REGIONS
    shards = {region: -(-n // shard_rows) for region, n in counts.items()}
    dealt = F.element_at(F.create_map(*[F.lit(x) for pair in shards.items() for x in pair]), F.col("region")) if shards else F.lit(1)
    rows = placed.withColumn("shard", F.pmod(F.xxhash64("vec_id"), dealt).cast("int"))
    return Index(rows, shards, regions, width, greatest)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, vector: str = "embedding", k: int = NEIGHBOURS, relax: float = RELAX) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of ``vectors`` for every usable row of ``queries``."""
    return build_index(vectors, vector).search(queries, vector, k, relax)
