"""Exact dedup, mixing, url filter and licence scan."""

import collections
import hashlib
import re

import compare
import pytest
from helpers import SF, WORD, awkward, empty, read
from pyspark.sql import functions as F

from emberfield.llm import exact, license, mixing, queries, urls


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    got = compare.from_spark(queries.QUERIES[name](spark, SF))
    assert compare.difference(got, compare.from_duckdb(compare.connect(SF), queries.oracle_sql()[name])) is None


def expected_groups(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [exact.content_digest, lambda t: F.unhex(F.substring(F.md5(t), 1, 1).substr(1, 1))])
def test_exact_groups_even_when_hashes_collide(spark, digest):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = exact.exact_groups(docs, digest=digest)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == [(a, b, c, d, e) for a, b, c, d, e in expected_groups(rows)]
    assert exact.exact_groups(empty(docs)).count() == 0


def test_drop_copies_keeps_rows_as_they_are(spark):
    docs = awkward(spark)
    kept = exact.drop_copies(docs)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    rows = sorted((r.doc_id or -1, r.text) for r in kept.collect())
    assert [i for i, _ in rows] == [-1, 2, 3, 4, 6, 7, 8, 9, 10, 11]
    assert exact.drop_copies(docs, keep="min").where("text is null").count() == 1
    assert exact.drop_copies(empty(docs)).count() == 0


def targets(sizes):
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), total
    while free:
        heavy = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / heavy > 3 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / heavy for s in free}
        for s in over:
            out[s], left = 3.0 * sizes[s], left - 3 * sizes[s]
            free.discard(s)
    return out


def test_mix_reaches_targets(spark):
    for docs in (read(spark, "documents"), awkward(spark)):
        rows = {}
        sizes = collections.Counter()
        for r in docs.collect():
            rows.setdefault(r.doc_id, []).append((r.source, len(WORD.findall(r.text or ""))))
            sizes[r.source] += len(WORD.findall(r.text or ""))
        got = mixing.mix_report(docs).collect()
        want = targets(sizes)
        taken = collections.Counter()
        assert len(got) == docs.count()
        for r in got:
            source = next(s for s, n in rows[r.doc_id] if n == r["size"] and sizes[s] == r.source_size)
            assert abs(r.target - want[source]) < 1e-6 and 0 <= r.taken <= 3 * r["size"]
            taken[source] += r.taken
        assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
        assert sorted(map(str, mixing.mix_report(docs).collect())) == sorted(map(str, got))
    assert mixing.mix_report(empty(docs)).count() == 0


def test_tree_keeps_quotas_and_fills_shards(spark):
    sources = spark.createDataFrame([(0, 1000), (1, 0), (2, 37), (3, 5)], "sid long, blocks long")
    rows = {r.sid: r.cuts for r in mixing.shard_quotas(sources, shards=7).collect()}
    assert {s: c[-1] for s, c in rows.items()} == {0: 1000, 1: 0, 2: 37, 3: 5}
    shard = [sum(c[m + 1] - c[m] for c in rows.values()) for m in range(7)]
    assert max(shard) - min(shard) <= 1
    assert all(c == sorted(c) for c in rows.values())


@pytest.mark.parametrize("bundle", [2, 3, 256])
def test_bundles_of_sources_keep_quotas_and_shard_sizes(spark, bundle):
    blocks = [0, 5, 1, 40, 3, 3, 0, 17, 200, 8]
    sources = spark.createDataFrame(list(enumerate(blocks)), "sid long, blocks long")
    cuts = {r.sid: r.cuts for r in mixing.shard_quotas(sources, shards=5, bundle=bundle).collect()}
    assert {s: c[-1] for s, c in cuts.items()} == dict(enumerate(blocks))
    assert all(a <= b for c in cuts.values() for a, b in zip(c, c[1:]))
    sums = [sum(c[m + 1] - c[m] for c in cuts.values()) for m in range(5)]
    assert sum(sums) == sum(blocks) and max(sums) - min(sums) <= 1


def test_hypergeometric_draws_have_the_right_mean(spark):
    draw = mixing.hypergeometric("n", "k", "d", "u")
    rows = spark.range(2000).selectExpr("500D n", "120D k", "200D d", "(id + 0.5D) / 2000 u").selectExpr(f"{draw} x")
    mean, spread, low, high = rows.selectExpr("avg(x)", "stddev(x)", "min(x)", "max(x)").first()
    assert abs(mean - 48) < 0.1 and abs(spread - (48 * 0.76 * 0.6 * 500 / 499) ** 0.5) < 0.1 and 0 <= low < high <= 120


def test_mix_rows_carry_the_words_taken(spark, tmp_path):
    docs = awkward(spark)
    mixed = mixing.mix(docs)
    words = collections.Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text or ""))
        if r.n_chars is not None:
            assert r.n_chars == len(r.text)
    taken = collections.Counter()
    for r in mixing.mix_report(docs).collect():
        taken[r.doc_id] += r.taken
    assert {k: v for k, v in taken.items() if v} == dict(words)
    mixing.write_mix(mixed, str(tmp_path / "mix"))
    assert spark.read.parquet(str(tmp_path / "mix")).count() == mixed.count()
    assert mixing.mix(empty(docs)).count() == 0


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def url_rule(host, path):
    fits = [(len(r), r, v) for r, v in urls.RULES if (h := r.split("/", 1)[0]) is not None
            and (host == h or host.endswith("." + h)) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def test_urls_against_brute_force(spark):
    pages = read(spark, "pages").select("page_id", "url").unionByName(spark.createDataFrame(
        [(-1, None), (-2, ""), (-3, "no scheme.net/"), (-4, "HTTP://A.Example.NET/en/x?y=1&z=2#f"), (-5, "http://net"), (-6, "a://b://org/fr/"),
         (-7, "http://ünet.net/" + "9" * 50_000), (-8, "x://example.com/de/é?"), (-8, "x://example.com/de/é?"), (-9, "x://a.org/fr/\n#"),
         (-10, "x://notexample.com/de/"), (None, "x://q.net/")], "page_id long, url string"))
    pages = pages.withColumns({"html": F.lit(None).cast("string"), "host": F.lit("own"), "features": F.lit(1), "verdict": F.lit("?")})
    got = urls.judge_urls(pages).collect()
    want = sorted(((r.page_id, *url_parts(r.url)) for r in pages.collect()), key=repr)
    assert sorted(((r.page_id, r.host, r.path) for r in got), key=repr) == want
    for r in got:
        rule, verdict = url_rule(r.host, r.path)
        assert r.rule == rule and r.verdict in ("block", "allow") and (verdict is None or r.verdict == verdict)
    assert urls.judge_urls(empty(pages)).count() == 0


def test_url_trees_learn_the_rules(spark):
    pages = read(spark, "pages", "/root/testdata/sf0.1")
    host, path = urls.split_url(F.col("url"))
    rule, verdict = urls.rule_of(host, path)
    truth = {r.page_id: r.v for r in pages.select("page_id", verdict.alias("v")).collect() if r.v}
    hidden = F.when(F.crc32(F.col("page_id").cast("string").cast("binary")) % 4 != 2, F.col("verdict"))
    rows = urls.lexical(pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("verdict", urls.rule_of(F.col("host"), F.col("path"))[1]))
    shown = rows.withColumn("verdict", hidden)
    stats = {k: urls.suffix_statistics(shown, k, 1000) for k in ("suffix", "domain", "section")}
    model = urls.fit_urls(urls.with_features(shown, stats))
    out = model.transform(urls.with_features(rows, stats)).where(F.crc32(F.col("page_id").cast("string").cast("binary")) % 4 == 2)
    held = [(r.prediction, truth[r.page_id]) for r in out.select("page_id", "prediction").collect() if r.page_id in truth]
    assert sum((p == 1) == (v == "block") for p, v in held) / len(held) > 0.95


def test_licences(spark):
    mit = next(t for n, t in license.TEXTS if n == "MIT")
    docs = awkward(spark, [
        (1, "The MIT Licence\nCopyright (c) 2020 Someone\n\n".replace("The MIT Licence\n", "") + mit.upper().replace(" ", "  ")),
        (2, "abc\nreleased under the MIT licence\nLicensed under CC-BY-NC 4.0\nend"), (3, None), (4, ""), (5, "...\n"),
        (6, "words before Released under the MIT License."), (7, mit + " more"), (7, mit + " more"),
    ])
    got = {r.doc_id: (r.text_license, r.line_licenses) for r in license.license_scan(docs).collect()}
    none = (None, "")
    assert got == {1: ("MIT", ""), 2: (None, "CC-BY-NC-4.0,MIT"), 3: none, 4: none, 5: none, 6: none, 7: none}
    assert license.license_scan(docs).count() == 8
    assert license.license_scan(empty(docs)).count() == 0
