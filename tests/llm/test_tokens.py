"""Token counts and BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyworks.llm.bpe import WordBpe, digest_texts, encode_texts
from tallyworks.llm.token_counts import TokenCounter, count_tokens

from .data import docs_of

BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
COUNTER = TokenCounter(public_tokenizers.path("byte_bpe_50k.json"))
BPE = WordBpe(public_tokenizers.path("word_bpe_49k.json"))

RNG = random.Random(3)
TEXTS = [
    "", "  ", "a<|endoftext|>b <|startoftext|><|endoftext|> x", "ΑΣ ΟΔΥΣΣΕΥΣ. ΣΑΣ", "aaaaaaaaaaaaaaaaaaaaaa " * 3, "İstanbul Ⅷ ½ 10² \x1c\x85 x K", "don't I'LL we'Ve 'S ſ's",
    " " * 1000 + "x" + "\n" * 50 + "y", "é 한 ﬁ", "😀👩‍👩‍👧 नमस्ते", "<|endoftext", "\r\n\r\n  \t x", "ab" * 20000, "".join(RNG.choice("abcdefghij0123456789+/") for _ in range(30000)),
]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_same_as_the_library(text):
    assert COUNTER.count(text) == len(BYTES.encode(text, add_special_tokens=False).ids)
    ids = WORDS.encode(text, add_special_tokens=False).ids
    (got,) = BPE.encode([text])
    assert np.frombuffer(got, "<u4").tolist() == ids
    assert BPE.decode(got) == WORDS.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", categories=["L", "N", "P", "S", "Z"], max_codepoint=0x2FF), max_size=60))
def test_same_as_the_library_on_any_text(text):
    assert COUNTER.count(text) == len(BYTES.encode(text, add_special_tokens=False).ids)
    (got,) = BPE.encode([text])
    assert np.frombuffer(got, "<u4").tolist() == WORDS.encode(text, add_special_tokens=False).ids


def test_counts(spark):
    texts = [*TEXTS, None]
    got = {r["doc_id"]: r for r in count_tokens(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n = len(BYTES.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 512)


def test_round_trip(spark):
    texts = [*TEXTS, None]
    docs = docs_of(spark, texts)
    got = {r["doc_id"]: r for r in digest_texts(docs).collect()}
    full = {r["doc_id"]: r for r in encode_texts(docs).collect()}
    for i, t in enumerate(texts):
        ids = WORDS.encode(t or "", add_special_tokens=False).ids
        decoded = WORDS.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
        assert full[i]["ids"] == ids and full[i]["decoded"] == decoded


def test_a_batch_is_taken_in_small_parts():
    bpe, held = WordBpe(public_tokenizers.path("word_bpe_49k.json")), []
    bpe.encode_block = lambda texts: held.append(sum(map(len, texts))) or [b""] * len(texts)
    taken = []
    texts = (taken.append(i) or "word " * 200 for i in range(10_000))  # as many as a batch of Arrow has
    next(bpe.encode(texts))
    assert len(taken) <= 300  # no list of the whole batch is made
    assert len(list(bpe.encode(["word " * 200] * 10_000))) == 10_000
    assert max(held) <= 300_000


def test_every_code_point():
    import numpy as np
    from tokenizers import Tokenizer

    from tallyworks.llm.bpe import TOKENIZER, WordBpe
    from tallyworks.llm.token_counts import tokenizer_file

    path = tokenizer_file(TOKENIZER)
    library, own = Tokenizer.from_file(path), WordBpe(path)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1b " for c in points[i : i + 16]) for i in range(0, len(points), 16)]
    for i in range(0, len(texts), 10000):
        some = texts[i : i + 10000]
        want = library.encode_batch(some, add_special_tokens=False)
        assert [ids for ids in own.encode(some)] == [np.array(w.ids, "<u4").tobytes() for w in want]
