"""URL filter: rules by host and path, then boosted trees on lexical features, trained from the urls that rules label."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import bounded_sample, lower_ascii

#: (host and path, verdict): fits the host and its subdomains where the url's path starts with the rule's.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Rules become one expression; longer lists are refused.
MAX_RULES = 500
MAX_FIT_ROWS = 20_000
#: A suffix is a feature of its own from this share of the labelled urls on, so there are at most 1 / share of them.
LEAST_SHARE = 0.001
PRIOR_WEIGHT = 20.0
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._~/?=&%+:#"
FEATURES = ("url_length", "host_length", "path_length", "host_labels", "path_depth", "digit_ratio", "entropy", "params",
            "suffix_share", "suffix_block", "domain_block", "section_block")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host from the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path up to ``? #`` or the end."""
    text = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null without one; equally long ones by code point."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} url rules")
    rule = verdict = F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        site, _, start = name.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def lexical(rows: DataFrame) -> DataFrame:
    """Adds the features that need the url alone, and the keys of its suffix statistics, to (url, host, path)."""
    url, labels = F.coalesce("url", F.lit("")), F.split("host", r"\.")
    length = F.greatest(F.length(url), F.lit(1)).cast("double")
    low = F.lower(url)
    # how often each letter of the alphabet comes; all other characters count as one more
    counts = F.transform(F.array(*map(F.lit, ALPHABET)), lambda c: F.length(low) - F.length(F.replace(low, c, F.lit(""))))
    known = F.aggregate(counts, F.lit(0), lambda a, n: a + n)
    bits = lambda n: F.when(n > 0, n / length * F.log2(length / n)).otherwise(0.0)
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    tail = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))
    out = rows.withColumns({
        "url_length": F.length(url).cast("double"), "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"), "host_labels": F.size(labels).cast("double"),
        "path_depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double"),
        "digit_ratio": digits / length,
        "entropy": F.aggregate(counts, F.lit(0.0), lambda a, n: a + bits(n)) + bits(F.length(low) - known),
        "params": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
        "suffix": tail(1), "domain": tail(2),
    })
    return out.withColumn("section", F.concat("domain", F.lit("/"), F.split_part("path", F.lit("/"), F.lit(2))))


def suffix_statistics(rows: DataFrame, key: str, labelled: int) -> DataFrame:
    """(key, share, blocked): of all urls the share with this key, of the labelled ones the smoothed blocked share.

    Counted over all rows with map-side sums. Only keys with ``LEAST_SHARE`` of the labelled urls are kept, so there are
    at most ``1 / LEAST_SHARE`` rows and they may be broadcast.
    """
    block = F.sum(F.when(F.col("verdict") == "block", 1).otherwise(0))
    known, total = F.count("verdict"), rows.count()
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), known.alias("known"), block.alias("block")).where(
        F.col("known") >= max(1, LEAST_SHARE * labelled)
    ).select(
        key, (F.col("n") / max(total, 1)).alias("share"),
        ((F.col("block") + PRIOR_WEIGHT / 2) / (F.col("known") + PRIOR_WEIGHT)).alias("blocked"),
    )


def with_features(rows: DataFrame, stats: dict[str, DataFrame]) -> DataFrame:
    """The vector of FEATURES; a key without statistics counts as rare and undecided."""
    for key, table in stats.items():
        names = {key: f"{key}_key", "share": f"{key}_share", "blocked": f"{key}_block"}
        table = F.broadcast(table.select(*[F.col(a).alias(b) for a, b in names.items()]))
        rows = rows.join(table, F.col(key) == F.col(f"{key}_key"), "left").withColumns({
            f"{key}_share": F.coalesce(f"{key}_share", F.lit(0.0)), f"{key}_block": F.coalesce(f"{key}_block", F.lit(0.5)),
        })
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def fit_urls(rows: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> GBTClassificationModel | str:
    """Trees for block (1) or allow (0) from (features, verdict) rows with a verdict, or the verdict if only one occurs.

    At most ``max_fit_rows`` rows are used, drawn by hash; without any, the verdict is allow.
    """
    known = rows.where("verdict is not null").select("page_id", "url", "verdict", "features")
    kinds = [r["verdict"] for r in known.select("verdict").distinct().limit(2).collect()]
    if len(kinds) < 2:
        return kinds[0] if kinds else "allow"
    sample = bounded_sample(known, max_fit_rows, "page_id", "url").withColumn("label", (F.col("verdict") == "block").cast("double"))
    return GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, seed=11).fit(sample.select("features", "label"))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score for every row of ``pages``.

    The verdict is the rule's where one fits, else that of trees trained on the urls that have one. A null url, or one
    without ``://``, has empty host and path, fits no rule and is judged by the trees. Repeated rows repeat; other
    columns are ignored; an empty table gives an empty result.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = lexical(rows.withColumns({"rule": rule, "verdict": verdict}))
    labelled = rows.select(F.count("verdict")).first()[0]
    stats = {key: suffix_statistics(rows, key, labelled) for key in ("suffix", "domain", "section")}
    vectors = with_features(rows, stats)
    model = fit_urls(vectors, max_fit_rows)
    if isinstance(model, str):
        score = F.lit(1.0 if model == "block" else 0.0)
    else:
        vectors = model.transform(vectors)
        score = F.element_at(vector_to_array("probability"), 2)
    vectors = vectors.withColumn("block_score", score)
    guess = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return vectors.select("page_id", "host", "path", "rule", F.coalesce("verdict", guess).alias("verdict"), "block_score")
