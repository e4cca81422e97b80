"""BPE encoding and decoding with a merge automaton (operator 2).

Method.  The merges are compiled, in order, into a deterministic automaton over
token arcs.  Its states are "the token read last"; the arc ``u -> v`` exists iff
``v`` may follow ``u`` in a finished encoding.  One gadget per merge rule
``k: a b -> ab`` does three things: it adds the arc label ``ab`` (only if ``b``
could still follow ``a``), gives ``ab`` the edges of ``a`` (left) and ``b``
(right), and removes, from every state whose right edge is ``a`` while rule
``k`` fires, all arcs whose left edge is then ``b``.  The removals are kept in
factored form: per token its two parts and the rule that bore it (so its edge
tokens and the span of rules during which each is the live one), plus the table
of rules.  A full state x label
matrix would have 2.4e9 cells; the factored form has a few entries per token,
and the transition table is filled from it as pairs are met.

Encoding walks the automaton over a pre-split word: from the current state take
the longest arc that spells the next bytes, step back when none leads on.  Each
prefix of a word has at most one accepted path, so a position that failed once
is dead and the walk is bounded by (word length x longest label).  Decoding
emits arc labels.

Edge cases: a null text is the empty text (0 tokens, hash of no bytes); strings
of the special tokens inside a text become their ids, as the library does;
repeated rows are encoded like any other; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

WORD_END = "</w>"
#: One character that no byte symbol uses; stands for the end of a word inside arc labels.
END = "\n"
#: Unicode white space, and the pre-split pattern of the tokenizer file.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")
#: Outside the characters on which the Unicode tables of ``regex`` and of the tokenizers library agree (checked one by one
#: in the tests); a text with such a character is normalised and pre-split by the library itself.
UNSETTLED = regex.compile("[^\x00-\u0557\u2000-\u206f\u20a0-\u20bf\u2100-\u214f\u3040-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")
#: Bounds of the per-worker tables; on reaching one the table starts empty again.
MAX_WORDS, MAX_ARCS = 150_000, 250_000
NEVER = 1 << 40


@functools.cache
def byte_symbols() -> tuple[str, ...]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    extra = iter(range(256, 512))
    shown = set(printable)
    return tuple(chr(b) if b in shown else chr(next(extra)) for b in range(256))


class MergeAutomaton:
    """Deterministic automaton of a merge list; see the module text."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.text = {i: t for t, i in vocab.items()}
        self.arcs: dict[str, int] = {}
        self.rules: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        self.step: dict[int, bool] = {}
        for s in byte_symbols():
            for t in (s, s + WORD_END):
                if t in vocab:
                    self.symbol(t, vocab[t])
        for k, (a, b) in enumerate(merges):
            self.gadget(k, vocab[a], vocab[b], vocab[a + b])
        self.longest = max(map(len, self.arcs), default=0)

    def symbol(self, token: str, u: int) -> None:
        self.arcs[label(token)] = u
        self.born[u] = -1

    def gadget(self, k: int, a: int, b: int, ab: int) -> None:
        open_path = a in self.born and b in self.born and self.follows(a, b)
        self.rules[a << 20 | b] = k
        if open_path:
            self.born[ab], self.parts[ab] = k, (a, b)
            self.arcs[label(self.text[ab])] = ab

    def edges(self, u: int, side: int) -> list[tuple[int, int, int]]:
        """Edge tokens of ``u`` at its left (0) or right (1) side, each with the rules between which it is the live one:
        born by the one, taken up into the next edge token by the other."""
        out, end = [], NEVER
        while True:
            out.append((u, self.born[u], end))
            if u not in self.parts:
                return out
            u, end = self.parts[u][side], self.born[u]

    def follows(self, u: int, v: int) -> bool:
        """Whether the automaton has the arc u -> v: no rule joins the two live edges."""
        rules, right = self.rules, self.edges(u, 1)
        for b, blo, bhi in self.edges(v, 0):
            for a, alo, ahi in right:
                k = rules.get(a << 20 | b)
                # equal rules fire from the left: one inside u comes before the border, one inside v after it
                if k is not None and alo < k < ahi and blo < k <= bhi:
                    return False
        return True

    def allowed(self, u: int, v: int) -> bool:
        key = u << 20 | v
        found = self.step.get(key)
        if found is None:
            if len(self.step) >= MAX_ARCS:
                self.step.clear()
            found = self.step[key] = self.follows(u, v)
        return found

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-split word, given in byte symbols."""
        s = word + END
        n, arcs, longest = len(s), self.arcs, self.longest
        path: list[tuple[int, int]] = []  # (end, id) of the arcs taken
        dead: set[int] = set()
        at, size = 0, min(longest, n)
        while at < n:
            last = path[-1][1] if path else -1
            while size:
                u = arcs.get(s[at:at + size])
                if u is not None and at + size not in dead and (last < 0 or self.allowed(last, u)):
                    break
                size -= 1
            if size:
                path.append((at + size, u))
                at += size
                size = min(longest, n - at)
            elif path:
                dead.add(at)
                end, _ = path.pop()
                at = path[-1][0] if path else 0
                size = end - at - 1
            else:
                raise ValueError("the merge list has no path for a word")
        return [u for _, u in path]


def label(token: str) -> str:
    return token[: -len(WORD_END)] + END if token.endswith(WORD_END) else token


class Codec:
    """Normalise, pre-split, encode and decode whole texts."""

    def __init__(self, spec: str):
        file = json.loads(spec)
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in file["model"]["merges"]]
        self.automaton = MergeAutomaton(file["model"]["vocab"], merges)
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.spec = spec
        self.text = self.automaton.text | {i: t for t, i in self.special.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words: dict[str, tuple[bytes, bytes]] = {}

    @functools.cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_str(self.spec)

    def word(self, w: str) -> tuple[bytes, bytes]:
        if len(self.words) >= MAX_WORDS:
            self.words.clear()
        symbols = byte_symbols()
        spelled = "".join([symbols[b] for b in w.encode()])
        found = self.words[w] = self.packed(self.automaton.encode_word(spelled))
        return found

    def packed(self, ids: list[int]) -> tuple[bytes, bytes]:
        return (b"".join([i.to_bytes(4, "little") for i in ids]),
                b"".join([b" " + self.text[i].encode() for i in ids]))

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids as little-endian 32-bit integers, and the decoded text."""
        parts = self.special_split.split(text) if self.special_split and "<|" in text else [text]
        ids, out = [], []
        for part in parts:
            if part in self.special:
                found = [self.packed([self.special[part]])]
            elif UNSETTLED.search(part):
                split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                found = [self.packed(self.automaton.encode_word(w)) for w, _ in split]
            else:
                known = self.words
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                found = [known.get(w) or self.word(w) for w in PRE_SPLIT.findall(part)]
            ids += [f[0] for f in found]
            out += [f[1] for f in found]
        return b"".join(ids), b"".join(out)[1:]

    def decode(self, ids: bytes) -> str:
        """Labels of the arcs, joined as the library joins tokens when the file names no decoder."""
        return " ".join(self.text[int.from_bytes(ids[i:i + 4], "little")] for i in range(0, len(ids), 4))


@functools.lru_cache(maxsize=2)
def codec_of(spec: str) -> Codec:
    """One compiled automaton per Python worker."""
    return Codec(spec)


def read_spec(path: str) -> str:
    """The tokenizer file; bounded by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        return f.read()


ENCODED = "doc_id long, ids binary, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _over_texts(docs: DataFrame, tokenizer_path: str, schema: str, row) -> DataFrame:
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))  # bounded by the vocabulary
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(spec.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [row(i, *codec.encode(t or "")) for i, t in
                        zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                kinds = {"doc_id": pa.int64(), "ids": pa.list_(pa.int32()) if "ids array" in schema else None}
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n)) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def _encoded_row(doc_id, ids: bytes, decoded: bytes):
    return doc_id, ids, decoded.decode()


def _digest_row(doc_id, ids: bytes, decoded: bytes):
    return doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _row(doc_id, ids: bytes, decoded: bytes):
    return (doc_id, len(ids) // 4, np.frombuffer(ids, "<u4").astype(np.int32).tolist(), hashlib.sha256(ids).hexdigest(),
            hashlib.sha256(decoded).hexdigest())


def encode_rows(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): what a training job reads."""
    return _over_texts(docs, tokenizer_path, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string", _row)


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids, decoded): ids as packed little-endian 32-bit integers. No shuffle; one pass over the texts."""
    return _over_texts(docs, tokenizer_path, ENCODED, _encoded_row)


def encode_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the same encoding, hashed inside the tasks."""
    return _over_texts(docs, tokenizer_path, DIGESTS, _digest_row)
