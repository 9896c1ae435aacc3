"""Mixing sources to target weights: block quotas split over shards by a multivariate-hypergeometric tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import written
from .texts import SPACE_CLASS, whole, word_count

SEED = 17
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SHARDS = 64
BLOCK_WORDS = 16_384
#: Members of a node of the splitting tree at most.
BUNDLE = 256
#: A prime above any number of blocks of a source: multiplying by it permutes the block numbers.
STRIDE = 2_147_483_647


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """(source, source_size, sid): sources numbered from 0 by code point, null last.

    The aggregated rows are put in order over several tasks; only one row per task is numbered in one place.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    parts = written(
        totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()),
        "mix-sources",
    )
    first = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    place = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return parts.join(first, "part").select("source", "source_size", (F.col("before") + place - 1).alias("sid"))


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Adds ``target``: shares of all words by weight, at most ``most`` times the source's words.

    What a source cannot take is shared again by weight. That equals ``least(most * size, level * weight)`` for one
    level, which rises from pass to pass until no further source reaches its limit; a pass is one aggregate of the
    source table and hands two sums to the driver.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("limit", (F.col("source_size") * most).cast("double"))
    total, heavy = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    total = float(total or 0)
    level = total / heavy if heavy else 0.0
    full = -1
    while True:
        capped = F.col("limit") < F.lit(level) * F.col("weight")
        n, taken, free = rows.agg(
            F.count_if(capped), F.sum(F.when(capped, F.col("limit"))), F.sum(F.when(~capped, F.col("weight")))
        ).first()
        if n == full or not free:
            break
        full, level = n, (total - (taken or 0.0)) / free
    return rows.withColumn("target", F.least("limit", F.lit(level) * F.col("weight"))).drop("weight", "limit")


def _log_factorial(x: str) -> str:
    series = f"({x} * ln({x}) - {x} + 0.5 * ln(2 * pi() * {x}) + 1 / (12 * {x}) - 1 / (360 * pow({x}, 3)))"
    return f"(CASE WHEN {x} <= 20 THEN ln(factorial(cast({x} as int))) ELSE {series} END)"


def hypergeometric(total: str, marked: str, drawn: str, u: str) -> str:
    """SQL: how many of ``drawn`` items are marked, for ``marked`` of ``total`` items, at quantile ``u``.

    The inverse distribution function over the values within eight standard deviations of the mean, which hold
    all but about 1e-15 of the weight; always inside the possible range.
    """
    low, high = f"greatest(0D, {drawn} + {marked} - {total})", f"least({drawn}, {marked})"
    mean = f"({drawn} * {marked} / greatest({total}, 1D))"
    spread = f"sqrt({mean} * (1 - {marked} / greatest({total}, 1D)) * (1 - {drawn} / greatest({total}, 1D)))"
    candidates = (
        f"sequence(cast(greatest({low}, floor({mean} - 8 * {spread}) - 9) as bigint), "
        f"cast(least({high}, ceil({mean} + 8 * {spread}) + 9) as bigint))"
    )
    weight = "-" + " - ".join(
        _log_factorial(x) for x in ("cast(v as double)", f"({marked} - v)", f"({drawn} - v)", f"({total} - {marked} - {drawn} + v)")
    )
    logs = f"transform({candidates}, v -> named_struct('v', v, 'w', {weight}))"
    scaled = (
        f"transform(transform(array({logs}), s -> named_struct('s', s, 'top', array_max(transform(s, d -> d.w)))), "
        "p -> transform(p.s, c -> named_struct('v', c.v, 'w', exp(c.w - p.top))))"
    )
    with_sum = f"transform({scaled}, s -> named_struct('s', s, 'goal', {u} * aggregate(s, 0D, (a, c) -> a + c.w)))"
    pick = (
        "aggregate(p.s, named_struct('left', p.goal, 'v', cast(null as bigint)), (a, c) -> named_struct("
        "'left', a.left - c.w, 'v', CASE WHEN a.v IS NULL OR a.left > 0 THEN c.v ELSE a.v END), a -> a.v)"
    )
    return f"element_at(transform({with_sum}, p -> {pick}), 1)"


def shard_quotas(sources: DataFrame, shards: int = SHARDS, seed: int = SEED, bundle: int = BUNDLE) -> DataFrame:
    """(sid, cuts): of each source's blocks in permuted order, ``cuts[m]`` come before shard m; ``shards + 1`` values.

    ``sources`` has sid and ``blocks``. All shards hold equally many blocks, give or take one. Sources are taken in
    bundles of ``bundle`` neighbours, these in bundles of bundles up to one: a bundle's quotas are split among its
    members once its own are known, so that no row holds more than ``bundle`` counts, however many sources there are.
    """
    own = sources.select(F.col("sid").alias("id"), F.col("blocks").cast("double").alias("k"))
    largest = own.agg(F.max("id")).first()[0] or 0
    height = 1
    while bundle**height <= largest:
        height += 1
    total = own.agg(F.sum("k")).first()[0] or 0.0
    even = F.transform(F.sequence(F.lit(0), F.lit(shards)), lambda m: F.floor(F.lit(total) * m / shards).cast("bigint"))
    cuts = None
    for level in reversed(range(height)):
        members = own.groupBy(F.floor(F.col("id") / bundle**level).cast("bigint").alias("sid")).agg(F.sum("k").alias("k"))
        bundles = members.groupBy(F.floor(F.col("sid") / bundle).cast("bigint").alias("id")).agg(
            F.array_sort(F.collect_list(F.struct("sid", "k"))).alias("counts")
        )
        known = bundles.withColumn("cuts", even) if cuts is None else bundles.join(cuts, "id")  # the top is one bundle
        cuts = _split(known, shards, f"{seed}, {level}").withColumnRenamed("sid", "id")
    return cuts.withColumnRenamed("id", "sid")


def _split(bundles: DataFrame, shards: int, seed: str) -> DataFrame:
    """(sid, cuts) for the members of bundles (id, counts, cuts), by a tree over the shards.

    From the root on, a node's shards fall into two halves; the left half's blocks are a draw without replacement
    from the node's blocks, so the counts by member are multivariate hypergeometric: member after member, a
    hypergeometric number given what the earlier ones took. The bundle's own cuts say how many blocks a half holds.
    """
    nodes = bundles.select("id", F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "counts", "cuts")
    u = f"(shiftrightunsigned(xxhash64({seed}, id, lo, hi, c.sid), 11) * pow(2D, -53))"
    draw = hypergeometric("a.total", "c.k", "a.drawn", u)
    left = f"""aggregate(counts,
        named_struct('total', aggregate(counts, 0D, (s, c) -> s + c.k), 'drawn', cast(cuts[mid] - cuts[lo] as double),
                     'got', cast(array() as array<struct<sid: bigint, k: double>>)),
        (a, c) -> element_at(transform(array(cast({draw} as double)), x -> named_struct(
            'total', a.total - c.k, 'drawn', a.drawn - x,
            'got', array_append(a.got, named_struct('sid', c.sid, 'k', x)))), 1),
        a -> a.got)"""
    for _ in range((shards - 1).bit_length()):
        nodes = (
            nodes.withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2).cast("int"))
            .withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, F.expr(left)))
            .selectExpr("id", "cuts", """explode(CASE WHEN hi - lo > 1 THEN array(
                named_struct('lo', lo, 'hi', mid, 'counts', left),
                named_struct('lo', mid, 'hi', hi, 'counts',
                    zip_with(counts, left, (c, d) -> named_struct('sid', c.sid, 'k', c.k - d.k))))
                ELSE array(named_struct('lo', lo, 'hi', hi, 'counts', counts)) END) AS node""")
            .select("id", "node.lo", "node.hi", "node.counts", "cuts")
        )
    cells = nodes.selectExpr("lo AS shard", "inline(counts)").groupBy("sid").agg(
        F.array_sort(F.collect_list(F.struct("shard", "k"))).alias("cells")
    )
    cuts = F.aggregate(
        "cells", F.array(F.lit(0).cast("bigint")), lambda a, c: F.array_append(a, F.element_at(a, -1) + c["k"].cast("bigint"))
    )
    return cells.select("sid", cuts.alias("cuts"))


def positions(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds ``start``: the words of the source's documents that come before this one in a random order.

    The order is that of a hash of doc_id. Sums run over 256 x 256 ranges of the hash per source first, so that a
    window holds a 65,536th of a source and a source with a third of all rows is no hot key. Rows that
    repeat doc_id and size are interchangeable.
    """
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = rows.withColumn("h", h).withColumn("high", F.shiftrightunsigned("h", 56)).withColumn(
        "low", F.shiftrightunsigned("h", 48) % 256
    )
    before = lambda *keys: W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)
    fine = rows.groupBy("sid", "high", "low").agg(F.sum("size").alias("n"))
    coarse = fine.groupBy("sid", "high").agg(F.sum("n").alias("n")).select(
        "sid", "high", F.coalesce(F.sum("n").over(before("sid", "high")), F.lit(0)).alias("first")
    )
    fine = fine.join(coarse, ["sid", "high"]).select(
        "sid", "high", "low",
        (F.col("first") + F.coalesce(F.sum("n").over(before("sid", "high", "low")), F.lit(0))).alias("first"),
    )
    within = W.partitionBy("sid", "high", "low").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(fine, ["sid", "high", "low"])
        .withColumn("start", F.col("first") + F.col("inside"))
        .drop("h", "high", "low", "inside", "first")
    )


def drawn_pieces(sizes: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """``sizes`` (doc_id, source, size, any others) with source_size, target and ``pieces``.

    A piece (pass, n_words, shard) says that a shard takes the first ``n_words`` words of the document, in the given
    pass over its source. A source is read in a random order as often as its target needs, cut into blocks
    of ``block_words`` words; the piece belongs to the block in which its copy of the document begins. Only the document
    in which a source's quota ends is taken in part.
    """
    sources = with_targets(numbered_sources(sizes)).withColumn("quota", F.floor(F.col("target") + 0.5).cast("bigint"))
    sources = sources.withColumn("blocks", F.ceil(F.col("quota") / block_words).cast("bigint"))
    sources = written(sources, "mix-targets")
    sources = written(sources.join(shard_quotas(sources, shards, seed), "sid"), "mix-quotas")
    rows = sizes.join(
        sources.withColumnRenamed("source", "own_source"), F.col("source").eqNullSafe(F.col("own_source"))
    ).drop("own_source")
    rows = positions(rows, seed)
    # a copy in pass p begins at p * source_size + start; it is taken as far as the quota reaches
    begin = lambda p: p * F.col("source_size") + F.col("start")
    taken = lambda p: F.greatest(F.lit(0), F.least("size", F.col("quota") - begin(p)))
    passes = F.filter(F.sequence(F.lit(0), F.lit(MOST_REPEATS)), lambda p: taken(p) > 0)
    block = lambda p: F.floor(begin(p) / block_words).cast("bigint")
    turned = lambda p: (block(p) * (F.lit(STRIDE) % F.col("blocks")) + F.xxhash64(F.lit(seed), "sid") % F.col("blocks")
                        + F.col("blocks")) % F.col("blocks")
    shard = lambda p: (F.size(F.filter("cuts", lambda c: c <= turned(p))) - 1).cast("int")
    pieces = F.transform(passes, lambda p: F.struct(p.alias("pass"), taken(p).alias("n_words"), shard(p).alias("shard")))
    return rows.withColumn("pieces", pieces).drop("sid", "quota", "blocks", "cuts", "start")


def mix_report(docs: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards for every row of ``docs``.

    ``taken`` adds up the words of the document's pieces in all shards, repeats counted; ``shards`` lists them. A null
    text has size 0; a null source is a source of its own, the last one. A corpus without words has zero targets.
    Repeated rows are documents of their own. An empty table gives an empty result. Other columns are ignored.
    """
    sizes = written(docs.select("doc_id", "source", word_count(whole("text")).alias("size")), "mix-sizes")
    rows = drawn_pieces(sizes, shards, block_words, seed)
    taken = F.aggregate("pieces", F.lit(0).cast("bigint"), lambda a, p: a + p["n_words"])
    return rows.select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), F.col("pieces.shard").alias("shards")
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space between the words kept."""
    units = F.split(text, f"(?<=[{SPACE_CLASS}])(?=[^{SPACE_CLASS}])")
    lead = F.when(text.rlike(f"^[{SPACE_CLASS}]"), 1).otherwise(0)
    return F.regexp_replace(F.array_join(F.slice(units, F.lit(1), (n + lead).cast("int")), ""), f"[{SPACE_CLASS}]+$", "")


def mix(docs: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mixed corpus: the columns of ``docs`` plus ``mix_shard`` and ``mix_order``, one row per piece.

    A document comes once per pass that takes it; where only a part is taken, ``text`` ends after the last word taken
    and ``n_chars`` (if there) is its new length. Rows repeating a doc_id are told apart by source, size and text hash.
    """
    own = W.partitionBy("doc_id").orderBy("source", "size", "digest")
    keyed = docs.withColumns({
        "mix_size": word_count(whole("text")), "mix_digest": F.xxhash64(whole("text")),
    })
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy("source", "mix_size", "mix_digest"))
    narrow = docs.select(
        "doc_id", "source", word_count(whole("text")).alias("size"), F.xxhash64(whole("text")).alias("digest")
    ).withColumn("nth", F.row_number().over(own))
    rows = drawn_pieces(written(narrow, "mix-sizes"), shards, block_words, seed)
    rows = rows.where(F.size("pieces") > 0).select(
        F.col("doc_id").alias("mix_id"), F.col("nth").alias("mix_nth"), F.col("size").alias("mix_full"), F.inline("pieces")
    ).select("mix_id", "mix_nth", "mix_full", F.col("pass").alias("mix_pass"), F.col("n_words").alias("mix_words"),
             F.col("shard").alias("mix_shard"))
    keyed = keyed.withColumn("mix_own", nth)
    joined = keyed.join(rows, keyed["doc_id"].eqNullSafe(rows["mix_id"]) & (F.col("mix_own") == F.col("mix_nth")))
    part = F.col("mix_words") < F.col("mix_full")
    cut = F.when(part, first_words(F.col("text"), F.col("mix_words"))).otherwise(F.col("text"))
    out = joined.withColumn("mix_order", F.xxhash64(F.lit(seed), "mix_shard", "mix_pass", "doc_id")).withColumn("mix_text", cut)
    columns = [F.col("mix_text").alias("text") if c == "text" else
               F.when(part, F.length("mix_text")).otherwise(F.col(c)).cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`")
               for c, t in docs.dtypes]
    return out.select(*columns, "mix_shard", "mix_order")


def write_mix(mixed: DataFrame, path: str) -> None:
    """Shards as folders, each shuffled locally: rows in the order of their hash within the shard."""
    mixed.repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_order").drop("mix_order").write.partitionBy(
        "mix_shard"
    ).parquet(path)
