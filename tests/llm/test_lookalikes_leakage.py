import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanweave.llm import leakage as K
from spanweave.llm import lookalikes as L

WORDS = ["рассказ", "орех", "café", "ромашка"]


@pytest.fixture(scope="module")
def form():
    return L.ConsistentForm(L.SpellingTrie(WORDS))


SAME = [
    ("shallow", "shаllоw"),
    ("café au lait", "café au lait"),
    ("Full width 123!", "Ｆｕｌｌ　ｗｉｄｔｈ １２３！"),
    ("auction", "auc​tio﻿n"),
    ("рассказ", "pаccкaз"),
    ("ｅ̈dge", "ёdge".replace("ё", "ё")),
    ("I'll go", "Ι'll gο"),
    ("soft­hyphen", "softhyphen"),
    ("ガ", "ガ"),
    ("\U0001f469‍\U0001f52c", "\U0001f469​‍\U0001f52c"),
]
SAME += [("a", "ɑ"), ("g", "ɡ"), ("i", "ı"), ("p", "ρ"), ("A", "Ꭺ"), ("o", "օ"), ("A", "𝐀"), ("I", "Ⅰ"), ("l", "ӏ"), ("μ", "\u00b5"), ("III", "Ⅲ"), ("fish", "ﬁsh"), ("Dž", "ǅ"), ("❤", "❤\ufe0f"), ("a", "a\u180b"), ("ῥοή", "ῤοή".replace("ῤ", "ῥ"))]
DIFFERENT = [("cafe", "café"), ("It", "it"), ("a b", "a  b"), ("a\nb", "a b"), ("x.", "x,"), ("m2", "m²"), ("don't", "don’t"), ("...", "…"), ("strasse", "straße"), ("\U0001f469‍\U0001f52c", "\U0001f469\U0001f52c"), ("1/2", "½"), ("еж", "ёж")]


@pytest.mark.parametrize("a, b", SAME)
def test_looks_the_same(form, a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_looks_different(form, a, b):
    assert form(a) != form(b)


def test_trie_spelling_wins_over_the_table(form):
    assert form("pаccкaз") == "рассказ"
    assert form("cкорo") == "скоро"  # no spelling: the script of its own letters
    assert form("сор") == "cop"  # nothing but look-alikes: Latin


def test_spellings_settle_doubtful_letters():
    spelled = L.ConsistentForm(L.SpellingTrie(["Italy", "long", "ltd"]))
    bare = L.ConsistentForm()
    assert spelled("ӏtaly") == "Italy" and bare("ӏtaly") == "ltaly"
    assert spelled("ӏong") == "long" and spelled("ӏt\u200bаly") == "Italy" and spelled("ӏtd") == "ltd"
    assert L.SpellingTrie(["Italy"]).find("ӏtaly") == "Italy" and spelled("Italy") == "Italy"


def test_vocabularies():
    import os

    from spanweave.llm.queries import _spellings

    if not all(map(os.path.exists, _spellings())):
        pytest.skip("no vocabularies")
    name, words = L.vocabulary_spellings(*_spellings())
    assert len(words) == len(set(words)) > 10_000 and name == L.vocabulary_spellings(*_spellings())[0] != L.vocabulary_spellings(_spellings()[0])[0]
    assert L.form_of((name, words)) is L.form_of((name, words)) and L.form_of((name, words))("ѕhаllоw рассказ") == "shallow рассказ"
    with pytest.raises(FileNotFoundError):
        L.vocabulary_spellings("/nowhere/words.tiktoken")
    assert L.vocabulary_spellings()[1] == []


def test_too_many_spellings(monkeypatch):
    monkeypatch.setattr(L, "MOST_SPELLINGS", 2)
    with pytest.raises(ValueError):
        L.SpellingTrie(["a", "b", "c"])


ALPHABET = "ab I.1_\n\u0301\u0327\u0308\u200b\u200d\ufe0fｅｶﾞﾊﾟ，Ⅲﬁéёйе한\u1112\u1161\u11abガ\u3099\U0001f469\U0001f52c\u2764ӏ𝐀ǅ\u00a0²"


def letters(text):
    """Base letters in Latin: a word's script may depend on letters beyond a mark, its letters don't."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()).translate(L._LOOK) if c.isalnum())


@given(st.text(alphabet=ALPHABET, max_size=24))
@settings(max_examples=400, deadline=None)
def test_places_lead_back_to_the_word(text):
    form = L.ConsistentForm(L.SpellingTrie(WORDS + ["Italy"]))
    whole = form(text)
    assert form(whole) == whole and unicodedata.is_normalized("NFC", whole)
    for w, a, b in K.word_spans(text, form):
        assert 0 <= a < b <= len(text) and letters(w) == letters(form(text[a:b]))


def test_spans_beside_composed_letters():
    form = L.ConsistentForm()
    for odd in ("\u1112\u1161\u11ab", "ﾊﾟ", "e\u0301\u0327", "Ⅷ"):
        text = f"abc {odd} ef"
        assert [text[a:b] for _, a, b in K.word_spans(text, form)] == ["abc", odd, "ef"]


def test_forms_are_stable(form):
    for a, b in SAME + DIFFERENT:
        for x in (a, b):
            assert form(form(x)) == form(x)
            assert unicodedata.is_normalized("NFC", form(x))
    bare = L.ConsistentForm()
    for a, b in SAME:
        assert bare(a) == bare(b)
    for a, b in DIFFERENT:
        assert bare(a) != bare(b)


def test_weighted_edits():
    trie = L.SpellingTrie(["ship", "shop", "орех"])
    assert trie.find("shіp") == "ship" and trie.find("shap") is None and trie.find("shap", 1) == "ship"
    assert trie.find("opex") == "орех" and trie.find("op​ex") == "орех" and trie.find("shoop", 1) == "shop" and trie.find("sho", 1) == "shop"


def test_pairs(spark):
    rows = [(1, "A text"), (2, "А text"), (3, "A text"), (4, "​"), (5, None), (6, ""), (7, " \n"), (8, " "), (2, "А text"), (9, "other"), (None, "A text"), (10, "x" * 200_000), (11, "x" * 199_999 + "х")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, form string")
    assert sorted(map(tuple, L.lookalike_pairs(df).collect())) == [(1, 2), (2, 3), (10, 11)]
    classes = {r["doc_id"]: (r["class_id"], r["n_spellings"]) for r in L.lookalike_classes(df).collect()}
    assert classes == {1: (1, 2), 2: (1, 2), 3: (1, 2), 9: (9, 1), 10: (10, 2), 11: (10, 2)}
    texts = {r["doc_id"]: (r["text"], r["changed"]) for r in L.consistent_text(df).collect()}
    assert texts[2] == ("A text", True) and texts[5] == (None, False) and texts[4] == ("", True)
    assert L.lookalike_pairs(df.limit(0)).count() == 0


def test_leaks(spark):
    item = "The quick brown fox jumps over the lazy dog while seven green parrots watch quietly"
    words = item.split()
    docs = [
        (1, "Before. " + " ".join(words[:12]) + " after."),
        (2, " ".join(words[:11])),
        (3, "x " + ", ".join(words[2:]).upper().replace("E", "Е") + " y"),
        (4, " ".join(words[:6] + ["extra"] + words[6:])),
        (5, None),
        (6, ""),
        (7, "the​ quick brown fox jumps over the lazy dog while sevеn green; " + "filler " * 20_000),
        (7, "the​ quick brown fox jumps over the lazy dog while sevеn green; " + "filler " * 20_000),
        (None, item),
    ]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(100, item), (101, "too short"), (102, None), (103, item), (100, item)], "item_id long, item_text string")
    found = sorted(map(tuple, K.leaked_passages(df, items).collect()))
    assert found == [(d, i) for d in (1, 3, 7) for i in (100, 103)]
    spans = {(r["doc_id"], r["item_id"]): r for r in K.leaked_passages(df, items, spans=True).collect()}
    assert docs[0][1][spans[1, 100]["char_start"] : spans[1, 100]["char_end"]] == " ".join(words[:12])
    assert spans[3, 100]["n_words"] == 13 and docs[2][1][spans[3, 100]["char_start"] : spans[3, 100]["char_end"]] == docs[2][1][2:-2]
    text = docs[6][1]
    assert text[spans[7, 100]["char_start"] : spans[7, 100]["char_end"]].strip("​") == text[: text.index(";")]
    assert K.leaked_passages(df.limit(0), items).count() == 0 and K.leaked_passages(df, items.limit(0)).count() == 0


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(K, "ITEMS_PER_PASS", 2)
    texts = [" ".join(f"w{i}x{k}" for k in range(12)) for i in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, item_text string")
    assert sorted(map(tuple, K.leaked_passages(df, items).collect())) == [(i, i) for i in range(5)]
