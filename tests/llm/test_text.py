"""BPE, SimHash, quality, personal data, toxicity, substring dedup and the pipeline."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from helpers import SF, WORD, awkward, empty, read
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from emberfield.llm import bpe, components, pii, quality, queries, simhash, substring, texts, toxicity, trees


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(queries.tokenizer_path())
    out.no_truncation()
    out.no_padding()
    return out


def test_bpe_equals_the_library(spark, library):
    docs = read(spark, "documents").select("doc_id", "text").unionByName(awkward(spark).select("doc_id", "text"))
    seen = collections.Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        seen[r.doc_id, len(ids), digest, hashlib.sha256(decoded.encode()).hexdigest()] += 1
    got = collections.Counter(tuple(r) for r in bpe.token_report(docs, queries.tokenizer_path()).collect())
    assert got == seen
    assert bpe.token_report(empty(docs), queries.tokenizer_path()).count() == 0


def test_bpe_on_random_strings(library):
    mine, rng = bpe.loaded(queries.tokenizer_path()), random.Random(3)
    pool = [chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x500), rng.randrange(0x500, 0xD7FF), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(2000)]
    pool += [*"ΣσςİıẞßÅ", "A\u030a", "\u2003", "\u0085", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "\x1c", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(25)))
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    for word in ("ab" * 900, "a" * 2000, "hahaha" * 99, "!" * 700):
        assert np.frombuffer(mine.encode(word), "<u4").tolist() == library.encode(word, add_special_tokens=False).ids


def test_pair_test_agrees_with_merging():
    mine, rng = bpe.loaded(queries.tokenizer_path()), random.Random(4)
    tokens = [t for t in mine.ids if mine.alone(t)]
    plain = [t for t in tokens if ord(t[-1]) < mine.END]
    for _ in range(5000):
        left, right = rng.choice(plain), rng.choice(tokens)
        assert mine.compatible(left, right) == (mine.merged(left + right) == [left, right])


def test_bpe_encodes_and_decodes_in_one_worker(spark):
    docs, path = awkward(spark), queries.tokenizer_path()
    for packed in (False, True):
        one = bpe.encode(docs, path, packed, keep=("row", "text"), decoded=True)
        two = bpe.decode(bpe.encode(docs, path, packed, keep=("row", "text")), path)
        assert one.columns == two.columns and collections.Counter(map(str, one.collect())) == collections.Counter(map(str, two.collect()))
    plan = corpus_pipeline.token_ids(spark, docs, None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_bpe_arrays_and_packed_ids_agree(spark):
    docs, path = awkward(spark), queries.tokenizer_path()
    a = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(docs, path, keep=("doc_id", "lang")), path).collect()}
    b = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(docs, path, packed=True), path).collect()}
    assert a == b and a[1] == ""


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, most=2):
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    array = np.array(values, np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1:] ^ array[i]) <= most):
            a, b = root(v), root(values[i + 1 + int(j)])
            parent[max(a, b)] = min(a, b)
    return {v: root(v) for v in values}


@pytest.mark.parametrize("which", ["documents", "awkward"])
def test_simhash_against_brute_force(spark, which):
    docs = read(spark, "documents") if which == "documents" else awkward(spark)
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    root = brute_components(sorted({f for _, f in rows}))
    least = {}
    for i, f in rows:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    want = collections.Counter((i, f"{f:016x}", least.get(root[f])) for i, f in rows)
    assert collections.Counter(tuple(r) for r in simhash.near_groups(docs).collect()) == want
    assert simhash.near_groups(empty(docs)).count() == 0
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == {c for _, _, c in want}


def near_values(seed, centres=8, each=120):
    rng, out = random.Random(seed), set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(each):
            v = centre
            for _ in range(rng.randrange(5)):
                v ^= 1 << rng.randrange(64)
            out.add(v)
    return sorted(out)


@pytest.mark.parametrize("group_rows", [20_000, 3])
def test_links_have_the_brute_force_components(spark, group_rows):
    values = near_values(group_rows)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    edges = [(r.u, r.v) for r in simhash.linked(fps, group_rows=group_rows).collect()]
    pairs = np.array(edges, np.int64).view(np.uint64).reshape(-1, 2)
    assert (np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= 2).all()
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs.tolist():
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    assert {v: root(v) for v in values} == brute_components(values)


def test_trie_links_find_every_pair():
    values = np.array(near_values(9, 30, 200), np.uint64)
    got = {tuple(sorted(p)) for a, b in simhash.trie_links(values) for p in zip(a.tolist(), b.tolist())}
    want = set()
    for i, v in enumerate(values):
        want |= {(int(v), int(values[i + 1 + j])) for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ v) <= 2)}
    assert got == want
    half = values[::2], values[1::2]
    across = {(x, y) for a, b in simhash.trie_links(*half) for x, y in zip(a.tolist(), b.tolist())}
    assert across == {(int(a), int(b)) for a in half[0] for b in half[1][np.bitwise_count(half[1] ^ a) <= 2]}


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5001), (5001, 5002), (5002, 5000), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)} | {5000 + i: 5000 for i in range(3)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    repeated = {k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(repeated), n < 10 or 100 * len(repeated) > 20 * n


def test_quality_counts(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    model = quality.fit_quality(docs, labels)
    both = docs.select("doc_id", "text").unionByName(awkward(spark).select("doc_id", "text"))
    want = collections.Counter((r.doc_id, *brute_quality(r.text)) for r in both.collect())
    got = quality.quality_report(both, model).collect()
    assert collections.Counter(tuple(r)[:7] for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.keep_good(awkward(spark), model).schema == awkward(spark).schema
    assert quality.quality_report(empty(docs), model).count() == 0
    assert quality.fit_quality(docs, empty(labels)).score(np.zeros((1, len(quality.FEATURES))))[0] > 0


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read(spark, "documents", sf), read(spark, "labels", sf)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = quality.fit_quality(docs, labels.where(~fold))
    rows = quality.quality_report(docs.where(fold), model).where("not base_failed").join(labels, "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) / len(rows) > 0.97


def test_trees_obey_signs():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = (rng.random(3000) < 0.2 + 0.6 * np.abs(x[:, 0] - 0.4) + 0.2 * x[:, 1]).astype(float)
    model = trees.fit_trees(x, y, np.array([1, -1, 0]))
    for f, sign in ((0, 1), (1, -1)):
        grid = np.repeat(rng.random((50, 3)), 40, axis=0)
        grid[:, f] = np.tile(np.linspace(0, 1, 40), 50)
        steps = np.diff(model.score(grid).reshape(50, 40), axis=1) * sign
        assert (steps >= -1e-12).all()
    free = trees.fit_trees(x, (x[:, 0] > 0.5).astype(float), np.zeros(3))
    assert ((free.score(x) > 0.5) == (x[:, 0] > 0.5)).mean() > 0.99


def brute_base(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(digits) <= 19 and sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_against_plain_patterns():
    rng = random.Random(2)
    for _ in range(4000):
        text = "".join(rng.choice("aB0123456789..--++@@ ()_%\n4111 é") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == brute_base(text), repr(text)
    assert pii.base_spans("a" * 300_000 + "1" * 300_000 + "@" * 1000) == []


def test_pii_keeps_base_and_finds_repeats(spark):
    docs = read(spark, "documents", "/root/testdata/sf0.01")
    field = pii.fit_pii(docs)
    more = awkward(spark)
    both = docs.select("doc_id", "text").unionByName(more.select("doc_id", "text"))
    texts_of = collections.defaultdict(list)
    for r in both.collect():
        texts_of[r.doc_id].append(r.text or "")
    for r in pii.pii_spans(both, field).collect():
        fits = [t for t in texts_of[r.doc_id] if hashlib.sha256(pii.spell(brute_base(t)).encode()).hexdigest() == r.base_sha256]
        assert fits
        base = brute_base(fits[0])
        assert set(filter(None, pii.spell(base).split(","))) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.BASE_KINDS)
    assert pii.pii_spans(empty(docs), field).count() == 0
    text = 'and token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here'
    assert [s[0] for s in pii.added_spans(text, [], field)] == ["secret"]
    hidden = pii.masked(more, pii.pii_spans(more, field)).where("doc_id = 11").first().text
    assert "<email>" in hidden and "<card>" in hidden and "4111" not in hidden
    assert pii.added_spans("The year 1999 had 365 days and 4845168114407328 things.", [], field) == []


def test_digits_of_other_scripts_do_not_stop_the_field(spark):
    texts = ["1.2.3.²", "۱.۲.۳.4 and 5.6.7.٨", "x@1.²", "1²3.4.5.6"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.pii_spans(docs, pii.fit_pii(docs)).collect()
    assert [r.n_ip for r in sorted(rows)] == [len(re.findall(r"[0-9]+(?:\.[0-9]+){3}", t)) for t in texts]


def test_equal_tokens_agree():
    flags = np.zeros((3, pii.N_FLAGS))
    flags[:, 0] = 1
    field = pii.Field(np.zeros((pii.N_FLAGS, 6)), np.zeros((6, 6)), np.eye(6) * 3)
    field.unary[0, 0] = 0.5
    doc = pii.Document([(0, 1), (5, 6), (9, 10)], flags, np.empty((0, 2), int), np.array([[0, 1], [1, 2]]))
    assert field.labels(doc, np.array([4, 0, 0])).tolist() == [4, 4, 4]


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read(spark, "documents", sf), read(spark, "labels", sf)
    model = toxicity.fit_toxicity(docs, labels)
    rows = toxicity.toxicity_scores(docs, model).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.85 and hit / sum(r.predicted for r in rows) > 0.75
    spoilt = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(toxicity.fit_toxicity(docs, spoilt).weights, model.weights)
    odd = toxicity.toxicity_scores(awkward(spark), model).collect()
    assert len(odd) == 13 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in odd)
    assert toxicity.toxicity_scores(empty(docs), model).count() == 0
    nothing = toxicity.fit_toxicity(docs, empty(labels))
    assert nothing.score(["idiot"])[0] < 0.3


def test_gear_hashes_and_cuts():
    data = np.frombuffer(random.Random(5).randbytes(5000), np.uint8)
    got = substring.gear_hashes(data)
    for i in (0, 7, 15, 16, 1000, 4999):
        want = sum(int(substring.GEAR[data[i - k]]) << k for k in range(min(16, i + 1))) % 2**32
        assert int(got[i]) == want
    ends = substring.chunk_ends(data)
    shifted = substring.chunk_ends(np.concatenate([np.frombuffer(b"inserted", np.uint8), data]))
    assert set((ends + 8).tolist()) - set(shifted.tolist()) <= set((ends[:3] + 8).tolist())
    assert ends[-1] == 5000 and np.diff(ends, prepend=0).max() <= substring.LONGEST_CHUNK
    assert np.diff(substring.chunk_ends(np.zeros(1000, np.uint8)), prepend=0).max() <= substring.LONGEST_CHUNK


def test_shared_passages_are_found(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, planted = [], set()
    for k in range(60):
        passage = prose(55)
        for i in range(3):
            rows.append((10 * k + i, f"{prose(rng.randrange(200))} {passage} {prose(rng.randrange(200))}"))
            planted.add(10 * k + i)
        rows.append((10 * k + 9, prose(300)))
    docs = awkward(spark, [*rows, (None, rows[0][1]), (9999, None), (9998, "")])
    spans = substring.repeated_spans(docs).collect()
    flagged = {r.doc_id for r in spans} | {i for r in spans for i in r.first_doc_ids}
    assert None in flagged  # the copy without an id
    assert flagged - {None} <= planted and len(planted - flagged) <= 3
    cut = {r.doc_id: r.text for r in substring.without_repeats(docs).collect()}
    assert len(cut[1]) < len(dict(rows)[1]) and cut[0] == dict(rows)[0] and cut[9] == dict(rows)[9] and cut[9999] is None
    assert substring.repeated_spans(empty(docs)).count() == 0


def test_word_count_and_sample(spark):
    rows = awkward(spark).select("text", texts.word_count(texts.whole("text")).alias("n")).collect()
    assert all(r.n == len(WORD.findall(r.text or "")) for r in rows)
    ids = spark.range(5000)
    first = {r.id for r in texts.bounded_sample(ids, 100, "id").collect()}
    assert len(first) == 100 and first == {r.id for r in texts.bounded_sample(ids.repartition(5), 100, "id").collect()}


def test_pipeline_stages(spark, library):
    """Each stage against brute force over its own input."""
    docs = read(spark, "documents")
    given, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, SF)
        seen[name] = (given, out)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        given = spark.createDataFrame(out.collect(), out.schema)
    rows = {name: ([r.asDict() for r in a.collect()], [r.asDict() for r in b.collect()]) for name, (a, b) in seen.items()}
    before, after = rows["quality rules"]
    quality_of = {r["doc_id"]: r.kept for r in queries.QUERIES["op5_quality"](spark, SF).collect()}
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if quality_of[r["doc_id"]])
    before, after = rows["exact dedup"]
    last = {}
    for r in before:
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(last.values())
    before, after = rows["SimHash near-dedup"]
    fp = {r["doc_id"]: brute_fingerprint(r["text"]) for r in before}
    root = brute_components(sorted(set(fp.values())))
    least = {}
    for i, f in fp.items():
        least[root[f]] = min(least.get(root[f], i), i)
    assert sorted(r["doc_id"] for r in after) == sorted(least.values())
    before, after = rows["mixing to target weights"]
    sizes, taken = collections.Counter(), collections.Counter()
    for r in before:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    whole = {r["doc_id"]: r["text"] for r in before}
    for r in after:
        taken[r["source"]] += len(WORD.findall(r["text"]))
        assert whole[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    from test_native import targets
    assert all(abs(taken[s] - t) <= 0.5 for s, t in targets(sizes).items())
    before, after = rows["BPE encoding and decoding"]
    assert len(before) == len(after)
    ids = {r["text"]: library.encode(r["text"], add_special_tokens=False).ids for r in before}
    assert sorted((r["doc_id"], ids[r["text"]]) for r in before) == sorted((r["doc_id"], r["ids"]) for r in after)
