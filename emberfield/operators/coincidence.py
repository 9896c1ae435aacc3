"""Cross-sensor confirmation: detections that another sensor saw nearby on the same day.

Two detections confirm each other when they come from different sources, share
the acquisition date, lie within a radius in planar metres and are at most a
few hours apart.

No list of pairs is ever built. A fine grid has cells just small enough that
any two points in one cell are within the radius, so inside a cell only sources
and minutes matter: at most 1440 rows per source, date and cell, however many
detections lie there. Only detections left open by that step look around, on a
second grid as wide as the radius: only at blocks that hold another source in a
fitting time slot, only at distinct positions, and by tiles where it is crowded.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import minute_of_day
from ..functions.places import sinusoidal
from ..session import written
from .skew import salted_join

# The reach of a confirmation.
RADIUS_M = 1000.0
WINDOW_MIN = 360

_CELL = ["_d", "_cx", "_cy"]
_MOMENT = [*_CELL, "_m", "_s"]
_SITE = [*_MOMENT, "_x", "_y"]


def _side(radius_m: float) -> float:
    # below 1/sqrt(2), so the diagonal of a cell is shorter than the radius
    return radius_m * 0.707


def located(df: DataFrame, radius_m: float = RADIUS_M) -> DataFrame:
    """Adds planar position, cell, date text, minute and source keys to rows with coordinates."""
    x, y = sinusoidal(F.col("latitude"), F.col("longitude"))
    side = _side(radius_m)
    return (
        df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .withColumn("_x", x)
        .withColumn("_y", y)
        .withColumn("_cx", F.floor(F.col("_x") / side))
        .withColumn("_cy", F.floor(F.col("_y") / side))
        .withColumn("_d", F.coalesce(F.col("acq_date").cast("string"), F.lit("nan")))
        .withColumn("_m", minute_of_day(F.col("acq_time")))
        .withColumn("_s", F.coalesce(F.col("satellite_source"), F.lit("")))
    )


def _block(radius_m: float) -> list:
    """Keys of the coarse grid; a point's partners lie in its block or one of the eight around."""
    return [
        F.floor(F.col("_x") / radius_m).alias("_kx"), F.floor(F.col("_y") / radius_m).alias("_ky")
    ]


def _around(df: DataFrame) -> DataFrame:
    """One row per block of the three by three around a row's block, as (_nx, _ny)."""
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return df.withColumn("_nx", F.explode(F.transform(steps, lambda i: F.col("_kx") + i))).withColumn(
        "_ny", F.explode(F.transform(steps, lambda i: F.col("_ky") + i))
    )


def _slot(window_min: int):
    return F.floor(F.col("_m") / window_min)


_PARTNER_KEY = ["_d", "_nx", "_ny", "_ps", "_pslot"]
_ASKING_KEY = ["_d", "_kx", "_ky", "_s", "_slot"]

# Two neighbouring (block, source, slot) groups are compared site by site up to this product.
CROWDED = 1_000_000


def _block_pairs(asking: DataFrame, partners: DataFrame) -> DataFrame:
    """Which (block, source, slot) groups can hold partners of which, and the comparisons that takes.

    Both sides are reduced to their group sizes first: a few rows per block.
    """
    size = lambda df, key, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    return (
        _around(size(asking, _ASKING_KEY, "_na"))
        .join(size(partners, _PARTNER_KEY, "_np"), ["_d", "_nx", "_ny"])
        .where((F.col("_s") != F.col("_ps")) & (F.abs(F.col("_slot") - F.col("_pslot")) <= 1))
        .select(*_ASKING_KEY, *_PARTNER_KEY[1:], (F.col("_na") * F.col("_np")).alias("_work"))
    )


def _as_partner(sites: DataFrame, radius_m: float, window_min: int) -> DataFrame:
    kx, ky = _block(radius_m)
    return sites.select(
        "_d", kx.alias("_nx"), ky.alias("_ny"), F.col("_s").alias("_ps"),
        _slot(window_min).alias("_pslot"), F.col("_x").alias("_px"), F.col("_y").alias("_py"),
        F.col("_m").alias("_pm"), "_t",
    )


def _distance(x: str = "_px", y: str = "_py"):
    dx, dy = F.col("_x") - F.col(x), F.col("_y") - F.col(y)
    return F.sqrt(dx * dx + dy * dy)


def _close(radius_m: float, window_min: int):
    return (_distance() <= radius_m) & (F.abs(F.col("_m") - F.col("_pm")) <= window_min)


def _reached(
    asking: DataFrame, targets: DataFrame, radius_m: float, window_min: int, nearest: bool
) -> DataFrame:
    """The sites of ``asking`` with a site of another source among ``targets`` in reach.

    With ``nearest`` also ``_t`` of the nearest one, by whole millimetres, then the lowest ``_t``; otherwise the
    first partner ends the search. Groups whose product of sizes is large are refined by tiles.
    """
    asking = asking.select(*_SITE, *_block(radius_m), _slot(window_min).alias("_slot"))
    partners = _as_partner(targets, radius_m, window_min)
    pairs = written(_block_pairs(asking, partners), "blocks")
    probes = lambda some: salted_join(
        asking, some.drop("_work"), _ASKING_KEY, ["_x", "_y", "_m"], how="inner"
    )
    plain = probes(pairs.where(F.col("_work") <= CROWDED))
    answer = F.struct(F.floor(_distance() * 1000).alias("mm"), "_t").alias("_near")
    if nearest:
        found = plain.join(partners, _PARTNER_KEY).where(_close(radius_m, window_min)).select(*_SITE, answer)
    else:
        found = plain.alias("q").join(
            partners.alias("p"),
            [F.col(f"q.{k}") == F.col(f"p.{k}") for k in _PARTNER_KEY] + [_close(radius_m, window_min)],
            "left_semi",
        ).select(*_SITE)
    crowded = pairs.where(F.col("_work") > CROWDED)
    if not crowded.isEmpty():
        near = partners.join(crowded.select(*_PARTNER_KEY).distinct(), _PARTNER_KEY, "left_semi")
        sure, rim = _by_tiles(probes(crowded), near, radius_m, window_min, nearest)
        found = reduce(
            DataFrame.unionByName, [found, *sure, rim.select(*_SITE, *([answer] if nearest else []))]
        )
    if nearest:
        return found.groupBy(*_SITE).agg(F.min("_near").alias("_near")).select(*_SITE, "_near._t")
    return found.distinct()


def _by_tiles(
    probes: DataFrame, partners: DataFrame, radius_m: float, window_min: int, nearest: bool
) -> tuple[list[DataFrame], DataFrame]:
    """(tables of sites surely reached, site and partner rows of the rest) for crowded groups.

    The work grows with the sites and not their product. A site meets the tiles that hold partners, at most 256 per
    slot and block; of a tile's minutes the first and last in a slot decide. A tile wholly out of reach is dropped.
    For the nearest partner, tiles further away than the far corner of another one are dropped too; otherwise a
    tile wholly in reach answers for the site. The tiles left are split into tiles of about four metres. Positions
    have five decimals, so such a tile holds few distinct ones; these are compared.
    """
    inside, sure = [], []
    for level, parts in enumerate((16, 256)):
        side = radius_m / parts
        tx, ty = f"_tx{level}", f"_ty{level}"
        partners = partners.withColumn(tx, F.floor(F.col("_px") / side)).withColumn(
            ty, F.floor(F.col("_py") / side)
        )
        tile = [*_PARTNER_KEY, *inside, tx, ty]
        tiles = partners.groupBy(*tile).agg(F.min("_pm").alias("_first"), F.max("_pm").alias("_last"))
        # a slot is as long as the window, so its extremes tell whether any of its minutes fits
        in_time = (F.col("_last") >= F.col("_m") - window_min) & (F.col("_first") <= F.col("_m") + window_min)
        gap, span = [], []
        for axis, t in (("_x", tx), ("_y", ty)):
            low, high = F.col(t) * side - F.col(axis), F.col(axis) - (F.col(t) + 1) * side
            gap.append(F.greatest(low, high, F.lit(0.0)))
            span.append(F.greatest(F.abs(low), F.abs(high)))
        norm = lambda d: F.sqrt(d[0] * d[0] + d[1] * d[1])
        slack = 0.01  # metres; borders are left to the finer comparison
        met = written(
            salted_join(
                probes, tiles, [*_PARTNER_KEY, *inside], ["_x", "_y", "_m"], how="inner", heavy_work=True
            )
            .where(in_time & (norm(gap) <= radius_m + slack))
            .select(*_SITE, *tile[1:], norm(gap).alias("_gap"), norm(span).alias("_span")),
            "tiles",
        )
        if nearest:
            bound = met.groupBy(*_SITE).agg(F.min("_span").alias("_bound"))
            left = met.join(bound, _SITE).where(F.col("_gap") <= F.col("_bound") + slack)
        else:
            sure.append(met.where(F.col("_span") <= radius_m - slack).select(*_SITE).distinct())
            left = met.join(sure[-1], _SITE, "left_anti")
        probes = left.select(*_SITE, *tile[1:])
        inside += [tx, ty]
    rim = salted_join(
        probes, partners, [*_PARTNER_KEY, *inside], ["_x", "_y", "_m"], how="inner", heavy_work=True
    ).where(_close(radius_m, window_min))
    return sure, rim


def confirmed_sites(
    rows: DataFrame, radius_m: float = RADIUS_M, window_min: int = WINDOW_MIN
) -> tuple[DataFrame, DataFrame]:
    """(sites with their row counts, the confirmed ones) for rows from :func:`located`.

    A site is a distinct source, date, minute and position: copies collapse.
    The sites are stored once, as the steps below read them several times.
    """
    sites = written(rows.groupBy(*_SITE).agg(F.count(F.lit(1)).alias("_rows")), "sites")
    moments = sites.select(*_MOMENT).distinct()
    near = Window.partitionBy(*_CELL).orderBy("_m").rangeBetween(-window_min, window_min)
    # another source within the window exists unless the least and the greatest are both ours
    sure = (F.min("_s").over(near) != F.col("_s")) | (F.max("_s").over(near) != F.col("_s"))
    judged = moments.withColumn("_sure", sure)
    marked = written(
        salted_join(sites.drop("_rows"), judged, _MOMENT, ["_x", "_y"], how="inner"), "marked"
    )
    open_sites = marked.where(~F.col("_sure")).select(*_SITE)
    targets = sites.select(*_SITE, F.lit(0).cast("bigint").alias("_t"))
    beyond = _reached(open_sites, targets, radius_m, window_min, nearest=False)
    confirmed = marked.where("_sure").select(*_SITE).unionByName(beyond)
    return sites, confirmed


def with_co_confirmed(
    df: DataFrame, radius_m: float = RADIUS_M, window_min: int = WINDOW_MIN
) -> DataFrame:
    """All rows of ``df`` plus boolean ``co_confirmed``; rows without coordinates get false.

    There is no size limit above which the check is skipped.
    """
    columns = [c for c in df.columns if c != "co_confirmed"]
    rows = located(df.select(*columns), radius_m)
    sites, confirmed = confirmed_sites(rows, radius_m, window_min)
    flagged = salted_join(
        rows, confirmed.withColumn("_hit", F.lit(True)), _SITE, ["detection_id"], counts=sites
    )
    placed = flagged.select(*columns, F.coalesce("_hit", F.lit(False)).alias("co_confirmed"))
    unplaced = df.select(*columns).where(F.col("latitude").isNull() | F.col("longitude").isNull())
    return placed.unionByName(unplaced.withColumn("co_confirmed", F.lit(False)))


def first_partners(
    df: DataFrame, radius_m: float = RADIUS_M, window_min: int = WINDOW_MIN
) -> DataFrame:
    """(detection_id, partner_id): the nearest detection of another source for each confirmed one, then the lowest id.

    One row per confirmed detection, where a list of all pairs would be quadratic in a crowded place.
    """
    rows = written(located(df, radius_m).select("detection_id", *_SITE), "located")
    return _keepers(rows, rows, radius_m, window_min).withColumnRenamed("keeper_id", "partner_id")


# ---------------------------------------------------------------------------
# Merge mode
# ---------------------------------------------------------------------------

# Sources from the finest footprint to the coarsest; an earlier one is kept.
KEEP_ORDER = ("VIIRS_SNPP", "VIIRS_NOAA20", "MODIS")
MERGED_SUFFIX = "+MODIS"


#: Each source is one pass of the merge, as what it keeps depends on the sources before.
MAX_SOURCES = 50


def _keepers(
    queries: DataFrame, targets: DataFrame, radius_m: float, window_min: int
) -> DataFrame:
    """(detection_id, keeper_id) for each query row with a partner among ``targets``: the nearest, then the lowest id."""
    narrow = queries.select(*_SITE, "detection_id")
    target_sites = targets.groupBy(*_SITE).agg(F.min("detection_id").alias("_t"))
    found = _reached(narrow.select(*_SITE).distinct(), target_sites, radius_m, window_min, nearest=True)
    joined = salted_join(narrow, found, _SITE, ["detection_id"], how="inner")
    return joined.select("detection_id", F.col("_t").alias("keeper_id"))


def merge_coincident(
    df: DataFrame, radius_m: float = RADIUS_M, window_min: int = WINDOW_MIN,
    keep_order: Sequence[str] = KEEP_ORDER,
) -> DataFrame:
    """Merges confirmed detections into one record each, in a fixed order.

    Sources are taken in ``keep_order``, others after these by name: a detection
    that has a kept partner from an earlier source is dropped and absorbed by
    the nearest of them (then the lowest id), which then carries the larger FRP
    and a source suffix (once). A keeper whose own FRP is missing keeps it missing.
    """
    flagged = written(with_co_confirmed(df, radius_m, window_min), "flagged")  # read twice
    rows = written(
        located(flagged.where("co_confirmed"), radius_m).select("detection_id", "frp", *_SITE),
        "confirmed",
    )
    others = rows.where(~F.col("_s").isin(*keep_order)).select("_s").distinct().limit(MAX_SOURCES + 1).collect()
    if len(others) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources besides {keep_order}")
    kept = rows.where(F.col("_s") == keep_order[0])
    dropped = None
    for source in (*keep_order[1:], *sorted(r[0] for r in others)):
        candidates = rows.where(F.col("_s") == source)
        gone = written(_keepers(candidates, kept, radius_m, window_min), "absorbed")
        dropped = gone if dropped is None else dropped.unionByName(gone)
        kept = kept.unionByName(candidates.join(gone, "detection_id", "left_anti"))
    absorbed = (
        dropped.join(rows.select("detection_id", "frp"), "detection_id")
        .groupBy(F.col("keeper_id").alias("detection_id"))
        .agg(F.max("frp").alias("_frp"), F.lit(True).alias("_kept"))
    )
    merged = flagged.join(dropped.select("detection_id"), "detection_id", "left_anti").join(
        absorbed, "detection_id", "left"
    )
    frp = F.when(F.col("frp").isNotNull(), F.greatest("frp", "_frp"))
    source = F.when(
        F.col("_kept"), F.concat("satellite_source", F.lit(MERGED_SUFFIX))
    ).otherwise(F.col("satellite_source"))
    return (
        merged.withColumn("frp", F.when(F.col("_kept"), frp).otherwise(F.col("frp")))
        .withColumn("satellite_source", source)
        .select(*df.columns, *[c for c in ("co_confirmed",) if c not in df.columns])
    )
