"""BPE encoding by dynamic programming over prefixes, and decoding, for tokenizers with word-end symbols."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .texts import by_batch, strings

#: Chunks and words that a worker remembers; the frequent ones come early, later ones are computed anew.
REMEMBERED = 120_000

_NEVER = 1 << 30

_PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else from 256 upwards."""
    letters, spare = [], 256
    for b in range(256):
        printable = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b
        letters.append(chr(b if printable else spare))
        spare += not printable
    return letters


_LETTERS = byte_letters()
_LATIN = {chr(c): "".join(_LETTERS[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}


class ChunkTable(dict):
    """Text between ASCII white space, in UTF-8 -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, chunk: bytes) -> bytes:
        packed = b"".join(map(self.bpe.word_table.__getitem__, self.bpe.words(chunk.decode("utf-8", "replace"))))
        if len(self) < REMEMBERED and len(chunk) <= 64:
            self[chunk] = packed
        return packed


class WordTable(dict):
    """A word in byte letters -> its packed ids."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        ids = self.bpe.word_ids(word)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < REMEMBERED and len(word) <= 64:
            self[word] = packed
        return packed


class Bpe:
    """A tokenizer file with ranked merges and a word-end symbol.

    A word is a row of symbols, the last one marked as word end. Every prefix of symbols has one encoding, and its last
    token is the one token that ends there, whose front prefix is encoded, and that the front prefix's last token
    leaves unmerged. An automaton over the vocabulary gives the tokens ending at each symbol; following the last tokens
    from the end back gives the ids. The file's own normaliser and split pattern, run by the library, give the words.
    """

    #: Letter offset that marks the last symbol of a word.
    END = 0x10000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix")
        if model["type"] != "BPE" or not suffix or model["dropout"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError(f"{path}: not a word-end BPE file of the supported form")
        # only the normaliser and the split are the library's: its own tables stay empty
        parts = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "model": model | {"vocab": {}, "merges": [], "unk_token": None}}))
        self.normal, self.pieces = parts.normalizer.normalize_str, parts.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")

        def mark(token: str) -> str:
            body = token.removesuffix(suffix)
            return body[:-1] + chr(ord(body[-1]) + self.END) if body and body != token else token

        self.ids = {mark(t): i for t, i in model["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(mark(a), mark(b)): n for n, (a, b) in enumerate(pairs)}
        self.made_of = {a + b: (a, b, n) for (a, b), n in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        self.tokens = {i: t for t, i in self.ids.items()}
        self.front = max(*self.tokens, *self.special.values()) + 1  # stands for the empty prefix
        for token, i in self.ids.items():
            self.automaton.add_word(token, (len(token), i))
        self.automaton.make_automaton()
        self.sound: dict[str, bool] = {}
        self.fits: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.table, self.word_table = ChunkTable(self), WordTable(self)

    def merged(self, symbols: Iterable[str]) -> list[str]:
        """Merges in rank order, leftmost first: what the prefix method must agree with."""
        parts = list(symbols)
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, _NEVER), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == _NEVER:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def alone(self, token: str) -> bool:
        """Whether the merges build this token from its symbols."""
        known = self.sound.get(token)
        if known is None:
            known = self.sound[token] = self.merged(token) == [token]
        return known

    def edge(self, token: str, right: bool) -> list[tuple[str, int]]:
        """The parts that stand at a token's right (or left) end while it is built, with the rank that ends each."""
        known = self.edges[right].get(token)
        if known is None:
            known, part, until = [], token, _NEVER
            while True:
                known.append((part, until))
                made = self.made_of.get(part)
                if made is None:
                    break
                part, until = made[right], made[2]
            self.edges[right][token] = known
        return known

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two tokens side by side stay as they are.

        They do unless a part at the end of the left one and a part at the start of the right one merge while both
        stand there. A merge of equal rank further left comes first.
        """
        rank, starts = self.ranks.get, self.edge(right, False)
        return self.alone(right) and not any(
            (n := rank((a, b), _NEVER)) < until_a and n <= until_b and n != _NEVER
            for a, until_a in self.edge(left, True) for b, until_b in starts
        )

    def fit(self, pair: int, front: int, token: int) -> bool:
        right = self.tokens[token]
        known = self.alone(right) if front == self.front else self.compatible(self.tokens[front], right)
        if len(self.fits) < REMEMBERED:
            self.fits[pair] = known
        return known

    def word_ids(self, word: str) -> list[int]:
        """Ids of a word in byte letters."""
        symbols = word[:-1] + chr(ord(word[-1]) + self.END)
        last, fits = [-1] * (len(symbols) + 1), self.fits
        last[0] = self.front
        for end, (length, token) in self.automaton.iter(symbols):
            front = last[end + 1 - length]
            if front >= 0 and last[end + 1] < 0:
                pair = front << 32 | token
                known = fits.get(pair)
                if known or known is None and self.fit(pair, front, token):
                    last[end + 1] = token
        out, at = [], len(symbols)
        while at:
            out.append(last[at])
            at -= len(self.tokens[last[at]])
        return out[::-1]

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk in byte letters."""
        plain = _PLAIN.fullmatch(chunk)
        if plain:  # letters whose case, form and class no Unicode version changes, then marks: known pieces
            return ["".join([_LATIN.get(c, c) for c in part.lower()]) for part in plain.groups() if part]
        return [word for word, _ in self.pieces(self.normal(chunk))]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.special or not self.specials.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self._plain(text[at:m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.table.__getitem__, text.encode("utf-8", "replace").split()))


def token_names(spec: dict) -> dict[int, str]:
    """Id -> token as the file spells it, added tokens included."""
    return {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}


class Names(dict):
    """Id -> token, all that decoding needs."""

    def text(self, ids: list[int]) -> str:
        """The tokens as the file spells them, one space between them; unknown ids are left out."""
        try:
            return " ".join(map(self.__getitem__, ids))
        except KeyError:
            return " ".join([x for x in map(self.get, ids) if x is not None])


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """The tokenizer of a file, read once per worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


_NAMES: dict[str, Names] = {}


def loaded_names(path: str) -> Names:
    """The token names of a file, read once per worker."""
    if path not in _NAMES:
        with open(path, encoding="utf-8") as f:
            _NAMES[path] = Names(token_names(json.load(f)))
    return _NAMES[path]


def _ids_column(ids: list[bytes], packed: bool) -> pa.Array:
    if packed:
        return pa.array(ids, pa.binary())
    ends = np.cumsum([0, *[len(x) // 4 for x in ids]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def encode(docs: DataFrame, path: str, packed: bool = False, keep: Iterable[str] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """The columns ``keep`` and ``ids`` (array of int; ``packed``: little-endian 32-bit binary) of every whole text.

    Ids are those of the file's own merges, added tokens in a text included, without any that the
    text does not hold. Null and empty texts have no ids; repeated rows repeat. Every task reads the tokenizer file,
    which must be at ``path`` on all executors, once. With ``decoded`` also what :func:`decode` adds, from the ids in
    the same worker: two steps one after the other would keep two workers a task.
    """
    keep = list(keep)
    rows = docs.select(F.col("text").alias("bpe_text"), *[F.col(f"`{c}`") for c in keep])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(path)
        ids = [bpe.encode(t) for t in strings(batch.column(0))]
        columns = [*batch.columns[1:], _ids_column(ids, packed)]
        if decoded:
            spelled = loaded_names(path)
            columns.append(pa.array([spelled.text(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.string()))
        return pa.RecordBatch.from_arrays(columns, [*keep, "ids", "decoded"][:len(columns)])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], f"ids {'binary' if packed else 'array<int>'}", *["decoded string"] * decoded])
    return by_batch(rows, run, schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``, the text of the column ``ids`` (array or packed); null or empty ids decode to ""."""
    packed = dict(rows.dtypes)["ids"] == "binary"
    names = rows.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spelled, ids = loaded_names(path), batch.column(names.index("ids"))
        if packed:
            rows = (np.frombuffer(x.as_py() or b"", "<u4") for x in ids)
        else:
            rows = (x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.empty(0, int) for x in ids)
        texts = [spelled.text(x.tolist()) for x in rows]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    schema = ", ".join([*[f"`{c}` {t}" for c, t in rows.dtypes], "decoded string"])
    return by_batch(rows, run, schema)


def token_report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, then decoded from the ids."""
    rows = encode(docs, path, packed=True, decoded=True)
    return rows.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
