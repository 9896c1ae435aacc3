"""Personal data: fixed patterns, and a skip-chain conditional random field that keeps repeated tokens consistent."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import bounded_sample, by_batch, strings

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
LABELS = ("none", *KINDS)
#: Documents and tokens of a fit at most.
MAX_FIT_DOCS = 6_000
MAX_FIT_TOKENS = 60_000
ROUNDS = 8

Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
#: A word with a digit or an at-sign; words are tried from their first character only.
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
_NOT_DIGIT = re.compile(r"[^0-9]")
_SECRET = re.compile(r"(?i)(?<![a-z])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_/+-]{16,})")
_EDGE = ".,;:!?\"'()[]{}<>|#*$%&"


def luhn(digits: str) -> bool:
    """Whether the check digit is right: every second digit from the right doubled, digits of the products summed."""
    own = sum(map(int, digits[-1::-2]))
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (own + doubled) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from their at-signs in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans in code points, by start, then kind. Matches that fail their check are dropped."""
    if not _HINT.search(text):
        return []
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- the field ---------------------------------------------------------------------------------------------------

_COUNTS = ((1, 1), (2, 2), (3, 3), (4, 6), (7, 7), (8, 11), (12, 19), (20, 1 << 60))


def _octet(part: str) -> bool:
    """Whether this is a number up to 255 in plain digits; other scripts' and raised digits do not count."""
    return part.isascii() and part.isdigit() and len(part) < 4 and int(part) < 256


def _flags(token: str, before: str, near: tuple[bool, bool]) -> list[bool]:
    """What is seen of a token: its form, checks, the text before it and whether the neighbours are candidates."""
    body = token.strip(_EDGE)
    digits = _NOT_DIGIT.sub("", body)
    n, parts = len(digits), body.split(".")
    hexes = len(body) >= 24 and body.isascii() and body.isalnum()
    words = before.split()
    last, earlier = (words[-1] if words else ""), (words[-2] if len(words) > 1 else "")
    return [
        True, "@" in token, any(c.isalpha() for c in body), n == len(body), *[a <= n <= b for a, b in _COUNTS],
        len(parts) == 4, len(parts) == 4 and all(map(_octet, parts)),
        12 <= n <= 19 and luhn(digits), token.startswith("+"), "(" in token or ")" in token, "-" in body, hexes,
        token[:1] in "\"'", last in ("=", ":"), last[-1:] in ("=", ":"),
        bool(re.search(r"(?i)token|secret|passw|key", earlier + last)), last.startswith("+"), last.startswith("("), *near,
    ]


N_FLAGS = len(_flags("", "", (False, False)))


@dataclass
class Document:
    """A text's candidate tokens: spans, flags, chain links between neighbours and skip links between equal tokens."""

    spans: list[tuple[int, int]]
    flags: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def read(text: str) -> Document | None:
    """Candidates are the words with a digit or an at-sign; all other words are "none" by the field's definition.

    Neighbouring candidates are chained. A token is also linked to the next one, however far, that has the same
    letters and digits (case and punctuation aside), or the same seven or more digits.
    """
    spans = [m.span() for m in _TOKEN.finditer(text)] if _HINT.search(text) else []
    if not spans:
        return None
    touch = [text[a[1]:b[0]].isspace() and b[0] - a[1] <= 3 for a, b in zip(spans, spans[1:])]
    flags, skip, seen = [], [], {}
    for i, (start, stop) in enumerate(spans):
        near = (i > 0 and touch[i - 1], i < len(touch) and touch[i])
        flags.append(_flags(text[start:stop], text[max(0, start - 40):start], near))
        same = re.sub(r"[\W_]", "", text[start:stop]).lower()
        digits = _NOT_DIGIT.sub("", same)
        keys = {same, "#" + digits} if len(digits) >= 7 else {same}
        partners = {seen[k] for k in keys if k in seen}
        skip += [(j, i) for j in sorted(partners) if not (j == i - 1 and touch[j])]
        seen.update(dict.fromkeys(keys, i))
    chain = [(i, i + 1) for i, t in enumerate(touch) if t]
    return Document(spans, np.array(flags, float), np.array(chain, int).reshape(-1, 2), np.array(skip, int).reshape(-1, 2))


def known_labels(doc: Document, spans: list[Span]) -> np.ndarray:
    """Per token the label of the span that holds part of it, else 0."""
    out, k = np.zeros(len(doc.spans), int), 0
    ordered = sorted(spans, key=lambda s: s[1])
    for i, (start, stop) in enumerate(doc.spans):
        while k < len(ordered) and ordered[k][2] <= start:
            k += 1
        if k < len(ordered) and ordered[k][1] < stop:
            out[i] = LABELS.index(ordered[k][0])
    return out


@dataclass
class Field:
    """Log potentials: flags x label, label x next label in the chain, and label x label over skip links."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def labels(self, doc: Document, fixed: np.ndarray) -> np.ndarray:
        """The likeliest label of every token by loopy sum-product message passing; nonzero ``fixed`` labels hold."""
        own = doc.flags @ self.unary
        own[fixed > 0] = -30.0
        own[fixed > 0, fixed[fixed > 0]] = 30.0
        edges = np.concatenate([doc.chain, doc.skip])
        if not len(edges):
            return own.argmax(axis=1)
        tables = np.concatenate([np.broadcast_to(t, (len(e), *t.shape)) for t, e in ((self.chain, doc.chain), (self.skip, doc.skip))])
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        tables = np.concatenate([tables, tables.transpose(0, 2, 1)])  # [message, label at source, label at target]
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(source), len(LABELS)))
        for _ in range(ROUNDS):
            belief = own.copy()
            np.add.at(belief, target, message)
            out = (belief[source] - message[back])[:, :, None] + tables
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            message = 0.5 * message + 0.5 * (new - new.max(axis=1, keepdims=True))
        belief = own.copy()
        np.add.at(belief, target, message)
        return belief.argmax(axis=1)


def fit_field(flags: np.ndarray, labels: np.ndarray, near: np.ndarray, steps: int = 300, rate: float = 0.1) -> Field:
    """Pseudo-likelihood: every token's label given its flags and its neighbours' labels, by Adam.

    ``near`` counts, per token, the labels before it in the chain, after it in the chain, and over skip links.
    """
    k = len(LABELS)
    params = [np.zeros((N_FLAGS, k)), np.zeros((k, k)), np.zeros((k, k))]
    if not len(labels):
        params[0][0, 0] = 5.0
        return Field(*params)
    goal = np.eye(k)[labels]
    weight = np.where(labels > 0, 1.0, 0.5)[:, None] / len(labels)
    before, after, skip = near[:, :k], near[:, k:2 * k], near[:, 2 * k:]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        unary, chain, both = params
        z = flags @ unary + before @ chain + after @ chain.T + skip @ (both + both.T) / 2
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - goal) * weight
        s = skip.T @ d
        grads = [flags.T @ d, before.T @ d + d.T @ after, (s + s.T) / 2]
        for i, (q, g) in enumerate(zip(params, grads)):
            g = g + 1e-5 * q
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            q -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Field(params[0], params[1], (params[2] + params[2].T) / 2)


def fit_pii(docs: DataFrame, max_docs: int = MAX_FIT_DOCS, max_tokens: int = MAX_FIT_TOKENS) -> Field:
    """The field from at most ``max_docs`` documents, drawn by hash of their id; the driver gets at most ``max_tokens`` rows.

    Labels are the fixed patterns' spans and, for secrets, values assigned to a telling name.
    """
    chosen = bounded_sample(docs.select("doc_id").where("doc_id is not null").distinct(), max_docs, "doc_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.withColumnRenamed("doc_id", "sample_id")), F.col("doc_id") == F.col("sample_id"))
    k = len(LABELS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, places = [], []
        for text in strings(batch.column(0)):
            doc = read(text)
            if doc is None:
                continue
            seeds = base_spans(text) + [("secret", *m.span(1)) for m in _SECRET.finditer(text)]
            labels, near = known_labels(doc, seeds), np.zeros((len(doc.spans), 3 * k))
            for i, j in doc.chain:
                near[j, labels[i]] += 1
                near[i, k + labels[j]] += 1
            for i, j in doc.skip:
                near[j, 2 * k + labels[i]] += 1
                near[i, 2 * k + labels[j]] += 1
            found += [np.concatenate([[x], f, n]).astype("<f4").tobytes() for x, f, n in zip(labels, doc.flags, near)]
            text_key = hashlib.md5(text.encode()).hexdigest()
            places += [f"{text_key}:{start}" for start, _ in doc.spans]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(places, pa.string())], ["row", "place"])

    # ranked by text and position: tokens that look alike are drawn one by one
    tokens = by_batch(rows.select("text"), run, "row binary, place string")
    got = sorted(bytes(r["row"]) for r in bounded_sample(tokens, max_tokens, "place", "row").collect())
    data = np.frombuffer(b"".join(got), "<f4").astype(float).reshape(-1, 1 + N_FLAGS + 3 * k)
    return fit_field(data[:, 1:1 + N_FLAGS], data[:, 0].astype(int), data[:, 1 + N_FLAGS:])


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """What the field finds besides the fixed patterns, clear of their spans.

    Neighbouring tokens of one label are one span, without the punctuation around it. Cards must have 12 to 19
    digits and a right check digit, addresses four parts up to 255, phones 7 to 15 digits, secrets 16 characters.
    """
    doc = read(text)
    if doc is None:
        return []
    fixed = known_labels(doc, base)
    labels = field.labels(doc, fixed)
    joined = {tuple(x) for x in doc.chain.tolist()}
    out, i = [], 0
    while i < len(labels):
        j = i
        while j + 1 < len(labels) and labels[j + 1] == labels[i] and (j, j + 1) in joined and fixed[j + 1] == fixed[i] == 0:
            j += 1
        if labels[i] and not fixed[i]:
            start, stop = doc.spans[i][0], doc.spans[j][1]
            body = text[start:stop]
            start, stop = start + len(body) - len(body.lstrip(_EDGE)), stop - (len(body) - len(body.rstrip(_EDGE)))
            kind, body = LABELS[labels[i]], text[start:stop]
            digits = _NOT_DIGIT.sub("", body)
            right = {
                "email": "@" in body[1:-1], "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 7 <= len(digits) <= 15,
                "ip": body.count(".") == 3 and all(map(_octet, body.split("."))),
                "secret": len(body) >= 16 and body.isascii(),
            }[kind]
            if right:
                out.append((kind, start, stop))
        i = j + 1
    return [s for s in out if not any(b[1] < s[2] and s[1] < b[2] for b in base)]


def spell(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def pii_spans(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, text_md5 for every whole text.

    The counts and ``base_sha256`` are those of the fixed patterns; ``spans`` holds these and what the field adds, by
    start, then kind (email, ip, card, phone, secret), in code points, end exclusive. Null and empty texts have none.
    ``text_md5`` is the text's digest, so that spans are never taken for those of another text of the same id.
    Repeated rows repeat; other columns are ignored; an empty table gives an empty result.
    """
    names = [f"n_{k}" for k in BASE_KINDS]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, spelled, texts = [], [], [], []
        for text in strings(batch.column(1)):
            base = base_spans(text)
            every = sorted(base + added_spans(text, base, field), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
            counts.append([sum(s[0] == k for s in base) for k in BASE_KINDS])
            digests.append(hashlib.sha256(spell(base).encode()).hexdigest())
            spelled.append(spell(every))
            texts.append(hashlib.md5(text.encode()).hexdigest())
        columns = [pa.array(c) for c in np.array(counts, np.int64).T]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests), pa.array(spelled), pa.array(texts)],
                                          ["doc_id", *names, "base_sha256", "spans", "text_md5"])

    schema = ", ".join([f"doc_id {dict(docs.dtypes)['doc_id']}", *[f"{n} long" for n in names], "base_sha256 string, spans string, text_md5 string"])
    return by_batch(docs.select("doc_id", "text"), run, schema)


def masked(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with every span of ``spans`` (doc_id, text_md5, spans) replaced by its kind in angle brackets.

    Rows find their spans by id and text, a null id like any other, so an id that comes with several texts has each
    masked at its own places. Null and empty texts stay; repeated rows repeat; extra columns stay whatever their
    names; an empty table gives an empty result.
    """
    own = docs.select(F.struct("*").alias("row")).withColumn("digest", F.md5(F.coalesce("row.text", F.lit(""))))
    found = spans.select(F.col("doc_id").alias("span_id"), "text_md5", "spans").dropDuplicates(["span_id", "text_md5"])
    same = F.col("row.doc_id").eqNullSafe(F.col("span_id")) & (F.col("digest") == F.col("text_md5"))
    joined = own.join(found.where("spans <> ''"), same, "left").select("row", "spans")
    docs_columns = docs.columns
    at = docs_columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        columns = batch.column(0).flatten()
        for text, spelled in zip(columns[at].to_pylist(), batch.column(1).to_pylist()):
            pieces, done = [], 0
            for kind, a, b in (s.split(":") for s in (spelled or "").split(",") if s):
                if int(a) >= done:
                    pieces += [text[done:int(a)], f"<{kind}>"]
                done = max(done, int(b))
            out.append("".join([*pieces, text[done:]]) if pieces else text)
        columns[at] = pa.array(out, pa.string())
        return pa.RecordBatch.from_arrays(columns, docs_columns)

    return by_batch(joined, run, docs.schema)
