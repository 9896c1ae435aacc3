"""Reproducible samples, splits, folds and label noise by hash order.

Rows are ordered by ``md5("<seed>:<id>")`` and then by id. A sample of exactly
k rows is the rows up to the k-th key of that order, so once the key at that
rank is known, membership is a plain filter: no sort, no shuffle of whole rows
and no row numbers over one partition. The keys at the wanted ranks are found
from counts per hash prefix, which are few whatever the size of the data.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_DIGITS = 3
_WINDOW_ROWS = 1_000_000


def hash_key(id_col: str, seed: int | str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def _keyed(df: DataFrame, id_col: str, seed: int | str, by: str | None) -> DataFrame:
    stratum = F.col(by) if by else F.lit("all")
    return df.select(stratum.alias("s"), hash_key(id_col, seed).alias("h"), F.col(id_col).alias("i"))


def prefix_counts(df: DataFrame, id_col: str, seed: int | str, by: str | None = None) -> dict:
    """{class: {hash prefix: rows}}; without ``by``, all rows are one class."""
    prefix = F.substring("h", 1, _DIGITS)
    counts: dict = {}
    for s, p, n in _keyed(df, id_col, seed, by).groupBy("s", prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(s, {})[p] = n
    return counts


@dataclass(frozen=True)
class Key:
    """A position in the hash order; rows up to and including it are inside."""

    text: str
    row_id: object


@dataclass(frozen=True)
class Cuts:
    """Class sizes and, per class, the key at each requested rank (None: no row)."""

    sizes: dict
    keys: dict


def hash_cuts(
    df: DataFrame, id_col: str, seed: int | str, ranks: Callable[[dict], dict],
    by: str | None = None, window_rows: int = _WINDOW_ROWS, counts: dict | None = None,
) -> Cuts:
    """Keys at the ranks that ``ranks(sizes)`` asks for, per class of column ``by``.

    ``ranks`` maps the class sizes to {class: [rank, ...]}; rank 0 means "before
    all rows". What reaches the driver is one count per class and hash prefix,
    so ``by`` must be a label column with few distinct values. ``counts`` are those of :func:`prefix_counts`, if at hand.
    """
    keyed = _keyed(df, id_col, seed, by)
    counts = prefix_counts(df, id_col, seed, by) if counts is None else counts
    sizes = {s: sum(c.values()) for s, c in counts.items()}
    wanted = ranks(sizes)
    # (class, rank) -> [prefix that holds the rank, rank within it]
    places = {
        (s, r): _locate(counts[s], r) for s, rs in wanted.items() for r in rs if 0 < r
    }
    largest = max((counts[s][p] for (s, _), (p, _) in places.items()), default=0)
    depth = _DIGITS
    while largest > window_rows and depth < 32:
        depth += _DIGITS
        longer = F.substring("h", 1, depth)
        finer: dict = {}
        inside = _in_places(places, depth - _DIGITS)
        for s, p, n in (
            keyed.where(inside).groupBy("s", longer.alias("p"))
            .agg(F.count(F.lit(1)).alias("n")).collect()
        ):
            finer.setdefault((s, p[: depth - _DIGITS]), {})[p] = n
        places = {k: _locate(finer[(k[0], p)], r) for k, (p, r) in places.items()}
        largest = max(finer[(k[0], p[: depth - _DIGITS])][p] for k, (p, _) in places.items())
    found: dict = {}
    if places:
        order = Window.partitionBy("s", "p").orderBy("h", "i")
        ranked = (
            keyed.where(_in_places(places, depth))
            .withColumn("p", F.substring("h", 1, depth))
            .withColumn("r", F.row_number().over(order))
        )
        asked = F.lit(False)
        for (s, _), (p, r) in places.items():
            asked = asked | (F.col("s").eqNullSafe(F.lit(s)) & (F.col("p") == p) & (F.col("r") == r))
        for row in ranked.where(asked).collect():
            found[(row["s"], row["p"], row["r"])] = Key(row["h"], row["i"])
    keys = {
        s: [found[(s, *places[(s, r)])] if r > 0 else None for r in rs] for s, rs in wanted.items()
    }
    return Cuts(sizes, keys)


def _locate(counts: dict, rank: int) -> tuple[str, int]:
    for p in sorted(counts):
        if rank <= counts[p]:
            return p, rank
        rank -= counts[p]
    raise ValueError("rank beyond the number of rows")


def _in_places(places: dict, depth: int) -> Column:
    prefix = F.substring("h", 1, depth)
    inside = F.lit(False)
    for (s, _), (p, _) in places.items():
        inside = inside | (F.col("s").eqNullSafe(F.lit(s)) & (prefix == p))
    return inside


def up_to(key: Key | None, id_col: str, seed: int | str) -> Column:
    """True for rows at or before ``key`` in the hash order."""
    if key is None:
        return F.lit(False)
    h = hash_key(id_col, seed)
    return (h < key.text) | ((h == key.text) & (F.col(id_col) <= F.lit(key.row_id)))


def _per_class(cuts: Cuts, by: str | None, make: Callable[[list], Column], other: Column) -> Column:
    if not by:
        return make(cuts.keys["all"]) if cuts.keys else other
    out = other
    for s, keys in cuts.keys.items():
        out = F.when(F.col(by).eqNullSafe(F.lit(s)), make(keys)).otherwise(out)
    return out


def sample_exactly(df: DataFrame, k: int, id_col: str = "detection_id", seed: int | str = 42) -> DataFrame:
    """Exactly ``k`` rows (all rows when there are fewer), uniform by hash."""
    cuts = hash_cuts(df, id_col, seed, lambda n: {s: [min(k, c)] for s, c in n.items()})
    return df.where(_per_class(cuts, None, lambda ks: up_to(ks[0], id_col, seed), F.lit(False)))


def half_up_share(n: int, share: float) -> int:
    return int(n * share + 0.5)


def stratified_split(
    df: DataFrame, by: str = "category", test_share: float = 0.20,
    id_col: str = "detection_id", seed: int | str = 42,
) -> DataFrame:
    """Adds ``is_test``. Per class the share is exact; when a class has one row only,
    the split ignores classes."""
    plan = lambda n: {s: [half_up_share(c, test_share)] for s, c in n.items()}
    cuts = hash_cuts(df, id_col, seed, plan, by=by)
    if min(cuts.sizes.values(), default=2) < 2:
        by = None
        cuts = hash_cuts(df, id_col, seed, plan)
    flag = _per_class(cuts, by, lambda ks: up_to(ks[0], id_col, seed), F.lit(False))
    return df.withColumn("is_test", flag)


def stratified_subset(
    df: DataFrame, size: int, above: int = 50_000, by: str = "category",
    id_col: str = "detection_id", seed: int | str = 42,
) -> DataFrame:
    """A subset of about ``size`` rows with the class shares kept; the whole when n <= ``above``."""

    def plan(n: dict) -> dict:
        total = sum(n.values())
        if total <= above:
            return {}
        return {s: [max(1, half_up_share(c, size / total))] for s, c in n.items()}

    cuts = hash_cuts(df, id_col, seed, plan, by=by)
    if not cuts.keys:
        return df
    return df.where(_per_class(cuts, by, lambda ks: up_to(ks[0], id_col, seed), F.lit(False)))


def stratified_folds(
    df: DataFrame, folds: int = 3, by: str = "category",
    id_col: str = "detection_id", seed: int | str = 42, fold_col: str = "fold",
) -> DataFrame:
    """Adds the fold number; within each class the folds differ by at most one row."""
    plan = lambda n: {s: [c * f // folds for f in range(1, folds)] for s, c in n.items()}
    cuts = hash_cuts(df, id_col, seed, plan, by=by)

    def number(keys: list) -> Column:
        out = F.lit(folds - 1)
        for f in reversed(range(folds - 1)):
            out = F.when(up_to(keys[f], id_col, seed), f).otherwise(out)
        return out

    return df.withColumn(fold_col, _per_class(cuts, by, number, F.lit(0)).cast("int"))


def with_label_noise(
    df: DataFrame, share: float = 0.05, col: str = "category",
    id_col: str = "detection_id", seed: int = 7, to: str | None = None,
) -> DataFrame:
    """Replaces exactly max(1, int(share*n)) labels by a uniform pick among the labels
    present, which may be the old one. The result goes to the column ``to``, by default
    in place."""
    per_label = prefix_counts(df, id_col, seed, by=col)
    labels = sorted(s for s in per_label if s is not None)
    counts: Counter = Counter()
    for of_label in per_label.values():
        counts.update(of_label)
    total = sum(counts.values())
    if total == 0:
        return df.withColumn(to or col, F.col(col))
    cut = hash_cuts(df, id_col, seed, lambda n: {"all": [max(1, int(total * share))]}, counts={"all": dict(counts)})
    draw = F.conv(F.substring(hash_key(id_col, f"{seed}-label"), 1, 8), 16, 10).cast("bigint")
    pick = F.element_at(
        F.array(*[F.lit(s) for s in labels]), (draw % len(labels) + 1).cast("int")
    )
    return df.withColumn(
        to or col, F.when(up_to(cut.keys["all"][0], id_col, seed), pick).otherwise(F.col(col))
    )
