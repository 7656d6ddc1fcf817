import os
import random
from collections import Counter

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from spanweave.llm import bpe_automaton as B
from spanweave.llm.queries import TOKENIZERS

RANKS = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary files")


@pytest.fixture(scope="module")
def encoder():
    return B.WordEncoder(B.TokenizationAutomaton(B.load_ranks(RANKS)))


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=B.PRE_SPLIT, mergeable_ranks=B.load_ranks(RANKS), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(encoder, reference, text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert encoder.encode(text) == reference.encode_ordinary(text)
    assert encoder.automaton.decode(encoder.encode(text)) == text


def test_runs_and_long_texts(encoder, reference):
    rng = random.Random(5)
    texts = [c * n for c in "a=- 0é!" for n in (1, 2, 3, 5, 17, 64, 129, 400)]
    texts += ["".join(rng.choice("abeinorst") for _ in range(5000)), "héllo wörld\r\n\t " * 3000, "<|endoftext|> is text", "👩‍🔬🐸 ¯\\_(ツ)_/¯"]
    texts += ["".join(rng.choice(["the", "ing", "er", " ", "a", "\n", "1", "ß"]) for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    for text in texts:
        assert encoder.encode(text) == reference.encode_ordinary(text), text[:60]


def trained(rng, merges):
    """A vocabulary trained on random words, as byte-pair encoding does it: the commonest pair is merged next."""
    words = [[bytes([rng.choice(b"aaabbc")]) for _ in range(rng.randint(2, 12))] for _ in range(60)]
    ranks = {bytes([b]): i for i, b in enumerate(b"abc")}
    for _ in range(merges):
        pairs = Counter(p for w in words for p in zip(w, w[1:]) if p[0] + p[1] not in ranks)
        if not pairs:
            break
        best = max(pairs, key=lambda p: (pairs[p], p))
        ranks[best[0] + best[1]] = len(ranks)
        for w in words:
            k = 0
            while k < len(w) - 1:
                if (w[k], w[k + 1]) == best:
                    w[k : k + 2] = [best[0] + best[1]]
                k += 1
    return ranks


def test_small_vocabularies():
    """Trained merge lists against repeated merging of the best pair."""
    rng = random.Random(2)
    for _ in range(60):
        automaton = B.TokenizationAutomaton(trained(rng, 20))
        for _ in range(150):
            word = bytes(rng.choice(b"aabbc") for _ in range(rng.randint(1, 16)))
            assert automaton.encode_word(word) == automaton._spell(word, 1 << 40)


def test_json_vocabulary_is_the_same():
    assert B.load_ranks(RANKS.replace(".tiktoken", ".json")) == B.load_ranks(RANKS)


def test_corpus(spark, reference):
    rows = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (1, "Hello world", "x"), (None, "a", "x"), (5, "z" * 100_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = B.encode_corpus(df, RANKS)
    assert out.columns == ["doc_id", "ids"]
    got = sorted(((r["doc_id"] or 0, r["ids"]) for r in out.collect()), key=lambda r: r[0])
    hello = reference.encode_ordinary("Hello world")
    assert got == [(0, reference.encode_ordinary("a")), (1, hello), (1, hello), (2, []), (3, []), (5, reference.encode_ordinary("z" * 100_000))]
    back = {r["doc_id"]: r["text"] for r in B.decode_corpus(out, RANKS).collect()}
    assert back == {1: "Hello world", 2: "", 3: "", None: "a", 5: "z" * 100_000}
    assert B.encode_corpus(df.limit(0), RANKS).count() == 0
