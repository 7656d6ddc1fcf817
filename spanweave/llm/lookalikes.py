"""One consistent form for texts that look the same.

A text is brought to one width and font and decomposed, and every word that isn't plain ASCII runs through the trie of canonical spellings by a weighted edit automaton: replacing a letter by
a look-alike and skipping an ignorable cost nothing, any other edit costs more than is allowed, so its branch is cut. The best-ranked spelling met at cost
0 becomes the word's form, which also settles letters that look like more than one other; words without a spelling, and all that is no word, are
normalised by table. Both ways depend on a word's look only: words without such doubtful letters look alike exactly if their forms are equal.
The form keeps case, accents, punctuation, ordinary white space and line breaks.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.session import materialize

# Letters of other scripts, and rare Latin letters, over the Latin letters they look like.
LOOKS = (
    ("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝԌԚԜҮѵѴ", "ABESIJKMHOPCTYXaesijopcyxhdqwGQWYvV"),  # Cyrillic
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρϲϳϹͿ", "ABEZHIKMNOPTYXovpcjCJ"),  # Greek
    ("ՕՍՏԼօոսհյցզ", "OUSLonuhjgq"),  # Armenian
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),  # Cherokee
    ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),  # Lisu
    ("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲬⲨⲟⲣⲥ", "HIKMNOPCTXYopc"),  # Coptic
    ("ɑɡıȷᴄᴏᴜᴠᴡᴢꜱ", "agijcouvwzs"),  # Latin
)
# Letters that look like several; the table takes the first, a spelling may take any.
DOUBTFUL = {"ӏ": "lI", "Ӏ": "Il"}
# Characters without a look of their own; variation selectors besides.
IGNORABLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u180f\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
IGNORABLE += "".join(map(chr, [*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]))
# Spaces that look like the ordinary one.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Spellings that a worker holds at most; more are an error.
MOST_SPELLINGS = 1_000_000

_JOINER = "\u200d"


def _same_look(c: int) -> str | None:
    """What a character is another width, font or printed form of: full and half width, mathematical letters and digits, Roman numerals, digraphs, ligatures."""
    kind = unicodedata.decomposition(chr(c)).split(" ", 1)[0]
    printed = unicodedata.category(chr(c))
    wide = 0xFF01 <= c < 0xFFEF and kind in ("<wide>", "<narrow>")
    font = kind == "<font>" and printed[0] in "LN" and c != 0x2139
    joined = kind == "<compat>" and (printed == "Nl" and c < 0x3000 or c in (0xB5, 0x132, 0x133, 0xFB06) or 0x1C4 <= c <= 0x1CC or 0x1F1 <= c <= 0x1F3 or 0xFB00 <= c <= 0xFB04)
    return unicodedata.normalize("NFKD", chr(c)) if wide or font or joined else None


LATIN_OF = {k: v for letters, latin in LOOKS for k, v in zip(letters, latin, strict=True)} | {k: v[0] for k, v in DOUBTFUL.items()}
PRINTED = {c: to for c in [*range(0x80, 0x3000), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFFEF), *range(0x1D400, 0x1D800)] if (to := _same_look(c))}
_PRINT = {ord(c): " " for c in SPACES} | PRINTED
_BARE = {ord(c): None for c in IGNORABLE}
_DROP = {ord(c): None for c in IGNORABLE if c != _JOINER}
_FOLD = _PRINT | _DROP
_LOOK = {ord(k): v for k, v in LATIN_OF.items()}
_BACK: dict[str, dict[str, str]] = {}
for _c, _v in LATIN_OF.items():
    if (_script := unicodedata.name(_c).split(" ", 1)[0]) != "LATIN":
        _BACK.setdefault(_script, {}).setdefault(_v, _c)


def _alike() -> dict[str, tuple[str, ...]]:
    """Character -> the characters of a spelling that it may stand for at no cost."""
    groups: dict[str, set[str]] = {}
    for other, latin in LATIN_OF.items():
        if other not in DOUBTFUL:
            groups.setdefault(latin, {latin}).add(other)
    out = {c: tuple(sorted(g)) for g in groups.values() for c in g}
    return out | {c: tuple(x for v in latin for x in out.get(v, (v,))) for c, latin in DOUBTFUL.items()}


ALIKE = _alike()
#: A joiner between two pictographs is seen (it makes one picture of them); elsewhere it is not.
_STRAY_JOINER = re.compile("(?<![\u2190-\u2bff\U0001f000-\U0001faff])\u200d+|\u200d+(?![\u2190-\u2bff\U0001f000-\U0001faff])")
_WORD = re.compile(rf"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f{IGNORABLE}])*")
_INVISIBLE = re.compile(r"[\s\x00-\x1f\x7f-\x9f]+")
_SKIPPED = frozenset(IGNORABLE)
_PRINTED, _DROPPED = frozenset(map(chr, _PRINT)), frozenset(map(chr, _DROP))
#: A run of ASCII letters and characters beyond ASCII, of which it has at least one: words lie inside runs or are plain.
_RUN = re.compile(r"(?<![A-Za-z])[A-Za-z]*+[^\x00-\x7f][^\x00-@\[-`{-\x7f]*")


class SpellingTrie:
    """Canonical spellings, best first."""

    def __init__(self, spellings: Iterable[str] = ()):
        self.next: dict[int, int] = {}  # node << 21 | code point -> node
        self.word: dict[int, tuple[int, str]] = {}
        self.size = 1
        for rank, spelling in enumerate(spellings):
            if rank >= MOST_SPELLINGS:
                raise ValueError(f"more than {MOST_SPELLINGS} spellings")
            node = 0
            for c in unicodedata.normalize("NFD", spelling):
                key = node << 21 | ord(c)
                node = self.next.get(key, 0)
                if not node:
                    node = self.next[key] = self.size
                    self.size += 1
            self.word.setdefault(node, (rank, spelling))
        self._below: dict[int, list[int]] | None = None

    def _children(self, node: int) -> list[int]:
        if self._below is None:
            self._below = {}
            for key, to in self.next.items():
                self._below.setdefault(key >> 21, []).append(to)
        return self._below.get(node, [])

    def find(self, word: str, allowed: int = 0) -> str | None:
        """The spelling of least cost, then of best rank, within ``allowed`` paid edits of the decomposed ``word``.

        The automaton's states after each character are trie nodes with the cost so far; a look-alike costs 0, so does skipping an
        ignorable; another letter, a missing or an extra one costs 1.
        """
        states = self._skips({0: 0}, allowed)
        for c in word:
            if c in _SKIPPED:
                continue
            after: dict[int, int] = {}
            alike = ALIKE.get(c, (c,))
            for node, cost in states.items():
                for x in alike:
                    to = self.next.get(node << 21 | ord(x))
                    if to is not None and cost < after.get(to, 1 << 30):
                        after[to] = cost
                if cost < allowed:
                    after[node] = min(after.get(node, 1 << 30), cost + 1)
                    for to in self._children(node):
                        after[to] = min(after.get(to, 1 << 30), cost + 1)
            states = self._skips(after, allowed)
            if not states:
                return None
        best = min(((cost, *self.word[node]) for node, cost in states.items() if node in self.word), default=None)
        return best[2] if best else None

    def _skips(self, states: dict[int, int], allowed: int) -> dict[int, int]:
        open_ = [x for x in states.items() if x[1] < allowed]
        while open_:
            node, cost = open_.pop()
            for to in self._children(node):
                if cost + 1 < states.get(to, 1 << 30):
                    states[to] = cost + 1
                    if cost + 1 < allowed:
                        open_.append((to, cost + 1))
        return states


class ConsistentForm:
    """Callable str -> str; remembers runs of words."""

    def __init__(self, trie: SpellingTrie | None = None, memo_words: int = 200_000):
        self.trie, self.memo, self.memo_words = trie or SpellingTrie(), {}, memo_words

    def _by_table(self, word: str) -> str:
        """Latin prototypes; a word that keeps letters of another script is written in that script throughout."""
        word = word.translate(_BARE).translate(_LOOK)
        if not word.isascii():
            for c in word:
                if ord(c) > 0x2AF and unicodedata.category(c)[0] == "L":
                    back = _BACK.get(unicodedata.name(c, "").split(" ", 1)[0])
                    if back:
                        return "".join(back.get(x, x) for x in word)
        return word

    def _word(self, match: re.Match) -> str:
        word = match.group()
        if word.isascii():
            return word
        spelled = self.trie.find(word)
        return self._by_table(word) if spelled is None else unicodedata.normalize("NFD", spelled)

    def _run(self, match: re.Match) -> str:
        run = match.group()
        form = self.memo.get(run)
        if form is None:
            form = _WORD.sub(self._word, run)
            if len(run) <= 64:
                if len(self.memo) >= self.memo_words:
                    self.memo.clear()
                self.memo[run] = form
        return form

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text
        if not _PRINTED.isdisjoint(text):
            text = text.translate(_PRINT)
        text = _RUN.sub(self._run, unicodedata.normalize("NFD", text))
        if not _DROPPED.isdisjoint(text):
            text = text.translate(_DROP)
        if _JOINER in text:
            text = _STRAY_JOINER.sub("", text)
        return text if text.isascii() else unicodedata.normalize("NFC", text)

    def places(self, text: str, form: str) -> list[tuple[int, int]]:
        """For each character of ``form`` (the form of ``text``) the start and end of what it comes from in ``text``.

        A form's decomposition has one character for each of the text's own decomposition, printed forms spelled out and ignorables left out, as
        every replacement is one for one; so the two are laid side by side.
        """
        parts: list[tuple[int, str]] = []
        for i, c in enumerate(text):
            for x in unicodedata.normalize("NFD", c):
                parts += [(i, y) for y in unicodedata.normalize("NFD", x.translate(_FOLD))]
        at = 0
        while at < len(parts):  # marks in canonical order, each with its place
            end = at + 1
            if unicodedata.combining(parts[at][1]):
                while end < len(parts) and unicodedata.combining(parts[end][1]):
                    end += 1
                parts[at:end] = sorted(parts[at:end], key=lambda p: unicodedata.combining(p[1]))
            at = end
        out, at = [], 0
        for c in form:
            low, high = len(text), 0
            for x in unicodedata.normalize("NFD", c):
                while x != _JOINER and at < len(parts) and parts[at][1] == _JOINER:
                    at += 1
                if at >= len(parts):
                    raise ValueError("form and text don't belong together")
                low, high, at = min(low, parts[at][0]), max(high, parts[at][0] + 1), at + 1
            out.append((low, high))
        return out


def vocabulary_spellings(*paths: str) -> tuple[str, list[str]]:
    """Words of two letters or more among the tokens of public rank files, the earliest merges first, and a digest that names the list.

    Of words beyond ASCII only those that don't look like ASCII are taken: one that does has an ASCII form whatever the vocabulary holds.
    """
    out: dict[str, None] = {}
    if paths:
        from spanweave.llm.bpe_automaton import load_ranks

        for path in paths:
            for token, _ in sorted(load_ranks(path).items(), key=lambda x: x[1]):
                try:
                    word = token.decode("utf-8").strip()
                except UnicodeDecodeError:
                    continue
                if len(word) > 1 and all(unicodedata.category(c)[0] in "LM" for c in word) and (word.isascii() or not unicodedata.normalize("NFD", word).translate(_LOOK).isascii()):
                    out.setdefault(word)
    listed = list(out)
    return hashlib.blake2b("\0".join(listed).encode(), digest_size=16).hexdigest(), listed


_FORMS: dict[str, ConsistentForm] = {}


def form_of(spellings: tuple[str, list[str]]) -> ConsistentForm:
    """This worker's form for these spellings, built once."""
    name, listed = spellings
    if name not in _FORMS:
        _FORMS[name] = ConsistentForm(SpellingTrie(listed))
    return _FORMS[name]


def is_visible(form: str) -> bool:
    return bool(_INVISIBLE.sub("", form))


def consistent_text(df: DataFrame, vocabulary: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, text, changed)``: every row's text in the consistent form; null stays null with ``changed`` false. No shuffle."""
    spellings = df.sparkSession.sparkContext.broadcast(vocabulary_spellings(*vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = form_of(spellings.value)
        for batch in batches:
            old = batch.column(1).to_pylist()
            new = [None if t is None else form(t) for t in old]
            changed = [a != b for a, b in zip(old, new, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string()), pa.array(changed, pa.bool_())], names=[id_col, "text", "changed"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, text string, changed boolean")


def _digests(df: DataFrame, vocabulary: tuple[str, ...], id_col: str, text_col: str) -> DataFrame:
    """``(id, form, stored)``: 128-bit digests of the form and of the stored text, for rows with visible text."""
    spellings = df.sparkSession.sparkContext.broadcast(vocabulary_spellings(*vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = form_of(spellings.value)
        digest = lambda s: hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for batch in batches:
            ids, forms, stored = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None or i is None or not is_visible(new := form(text)):
                    continue
                ids.append(i)
                stored.append(digest(text))
                forms.append(stored[-1] if new == text else digest(new))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(forms, pa.binary()), pa.array(stored, pa.binary())], names=["id", "form", "stored"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, form binary, stored binary")


def lookalike_classes(df: DataFrame, vocabulary: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, class_id, n_spellings)``: one row per row with visible text; rows of one class look the same.

    ``class_id`` is the smallest id of the class, ``n_spellings`` the number of its different stored texts.
    """
    d = materialize(_digests(df, vocabulary, id_col, text_col))
    per_text = d.groupBy("form", "stored").agg(F.min("id").alias("id"))
    classes = per_text.groupBy("form").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_spellings"))
    return d.join(classes, "form").select(F.col("id").alias(id_col), "class_id", "n_spellings")


def lookalike_pairs(df: DataFrame, vocabulary: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col_a, id_col_b)``, a < b: rows with visible text whose stored texts differ and whose forms are equal.

    Only digests are shuffled. Forms with a single stored text (almost all) leave before the join; different stored texts of a form are paired
    first, their copies joined on afterwards, so copies with the same stored text are never compared. Null, empty and invisible texts and null
    ids make no pair; repeated rows count once.
    """
    d = materialize(_digests(df, vocabulary, id_col, text_col).distinct())
    texts = d.groupBy("form").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).where("lo <> hi").select("form")
    several = materialize(d.join(texts, "form"))
    stored = several.select("form", "stored").distinct()
    a, b = stored.alias("a"), stored.alias("b")
    apart = a.join(b, (F.col("a.form") == F.col("b.form")) & (F.col("a.stored") < F.col("b.stored"))).select(F.col("a.stored").alias("sa"), F.col("b.stored").alias("sb"))
    ends = several.select("id", "stored")
    pairs = apart.join(ends.select(F.col("id").alias("x"), F.col("stored").alias("sa")), "sa").join(ends.select(F.col("id").alias("y"), F.col("stored").alias("sb")), "sb").where("x <> y")
    return pairs.select(F.least("x", "y").alias(f"{id_col}_a"), F.greatest("x", "y").alias(f"{id_col}_b")).distinct()
