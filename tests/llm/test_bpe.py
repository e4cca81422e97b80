"""Operator 2: equal to the tokenizers library, and to plain merging on small merge lists."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wattlane.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_spec(PATH))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def same(codec, library, text):
    ids, decoded = codec.encode(text)
    want = library.encode(text, add_special_tokens=False).ids
    assert ids == b"".join(i.to_bytes(4, "little") for i in want), text
    assert decoded.decode() == codec.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_equals_library_on_texts(codec, library):
    rng = random.Random(1)
    texts = ["", "<|endoftext|> hi <|startoftext|>there", "<|endoftext", "ΑΣ ΣΑΣ İstanbul ﬁ \x1c \x85 x​y 日本語 😀👩‍👩‍👧 café café 12 don't", "\x00", "..!!??",
             "a" * 5000, "ha" * 700]
    texts += ["".join(rng.choice("abcdeinrthsou!. 'é") for _ in range(rng.randint(1, 40))) for _ in range(800)]
    texts += [c * n for c in "aeh.!w-" for n in range(1, 40)]
    for text in texts:
        same(codec, library, text)


def test_equals_library_on_every_code_point(codec, library):
    points = [p for p in range(1, 0x3100) if not 0xD800 <= p < 0xE000] + list(range(0x3100, 0x20000, 37))
    for p in points:
        if not 0xD800 <= p < 0xE000:
            same(codec, library, f"a{chr(p)}b1{chr(p)}́!")


def plain_merge(word, ranks):
    parts = list(word)
    while True:
        pairs = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        if not pairs:
            return parts
        rank = min(pairs)[0]
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and ranks.get((parts[i], parts[i + 1])) == rank:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


def test_gadgets_equal_plain_merging_on_random_merge_lists():
    for seed in range(60):
        rng = random.Random(seed)
        tokens, merges = ["a", "b", "c"], []
        while len(merges) < 12:
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens and len(a + b) < 9:
                merges.append((a, b))
                tokens.append(a + b)
        vocab = {t: i for i, t in enumerate([*bpe.byte_symbols(), *[a + b for a, b in merges]])}
        automaton = bpe.MergeAutomaton({**vocab, "\n": len(vocab)}, merges)
        automaton.symbol(bpe.END, len(vocab))
        ranks = {m: i for i, m in enumerate(merges)}
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            got = [automaton.text.get(i, "") for i in automaton.encode_word(word)][:-1]
            assert got == plain_merge(word, ranks), (merges, word)


def test_edge_rows(spark, planted, library, no_documents):
    got = {(r.doc_id, r.ids_sha256): r for r in bpe.encode_digests(planted, PATH).collect()}
    rows = planted.select("doc_id", "text").collect()
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        out = got[r.doc_id, hashlib.sha256(raw).hexdigest()]
        assert out.n_tokens == len(ids)
        assert out.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_digests(planted, PATH).count() == len(rows)
    assert bpe.encode_rows(no_documents, PATH).count() == 0
    null_id = spark.createDataFrame([(None, "one two")], "doc_id long, text string")
    row = bpe.encode_rows(null_id, PATH).first()
    assert row.doc_id is None and row.ids == library.encode("one two", add_special_tokens=False).ids
    assert bpe.encode_documents(null_id, PATH).first().decoded == "one</w> two</w>"
