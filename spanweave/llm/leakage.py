"""Held-out evaluation passages inside a training corpus, by one Aho-Corasick automaton.

Items are brought to the consistent form and cut into words; every run of ``min_words`` words is a pattern, so a text leaks an item exactly if
it contains a pattern of it. Each text is scanned once. A hit's place is carried back to the stored text, so that a span can be
cut out of it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.lookalikes import ConsistentForm, form_of, vocabulary_spellings

_RUN = re.compile(r"[^\W_]+")
#: Items a worker's automaton may hold; more are scanned in further passes over blocks of this many.
ITEMS_PER_PASS = 20_000


def form_words(text: str | None, form: ConsistentForm) -> list[str]:
    return [w.lower() for w in _RUN.findall(form(text))] if text else []


def build_automaton(items: list[tuple[int, str | None]], min_words: int, form: ConsistentForm) -> ahocorasick.Automaton | None:
    """Patterns `` w1 .. wn `` with the items that have them: (number of characters, [(item, first word)])."""
    patterns: dict[str, list[tuple[int, int]]] = {}
    for item, text in items:
        words = form_words(text, form)
        for k in range(len(words) - min_words + 1):
            patterns.setdefault(f" {' '.join(words[k : k + min_words])} ", []).append((item, k))
    if not patterns:
        return None
    automaton = ahocorasick.Automaton()
    for pattern, where in patterns.items():
        automaton.add_word(pattern, (len(pattern), where))
    automaton.make_automaton()
    return automaton


def word_spans(text: str, form: ConsistentForm) -> list[tuple[str, int, int]]:
    """The words of the form with the start and end in the stored text of what each comes from, ignorables and marks at its end left out."""
    whole = form(text)
    words = [(m.group().lower(), m.start(), m.end()) for m in _RUN.finditer(whole)]
    if whole == text:
        return words
    at = form.places(text, whole)
    return [(w, min(low for low, _ in at[a:b]), max(high for _, high in at[a:b])) for w, a, b in words]


_AUTOMATA: dict[str, ahocorasick.Automaton | None] = {}


def _automaton_of(name: str, items: list[tuple[int, str | None]], min_words: int, form: ConsistentForm) -> ahocorasick.Automaton | None:
    """This worker's automaton for these items, built once; the last one is kept."""
    if name not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[name] = build_automaton(items, min_words, form)
    return _AUTOMATA[name]


def _scan(df: DataFrame, block: list[tuple[int, str | None]], min_words: int, spellings: tuple[str, list[str]], id_col: str, text_col: str, spans: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((block, spellings))
    name = hashlib.blake2b(repr((block, min_words, spellings[0])).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
    schema = "doc_id long, item_id long" + (", first_word int, n_words int, char_start int, char_end int" if spans else "")

    def hits(text: str, automaton: ahocorasick.Automaton, form: ConsistentForm) -> Iterator[tuple]:
        new = form(text)
        line = f" {' '.join(_RUN.findall(new)).lower()} " if new.isascii() else f" {' '.join(w.lower() for w in _RUN.findall(new))} "
        found = list(automaton.iter(line))
        if not found:
            return
        if not spans:
            for item in {item for _, (_, where) in found for item, _ in where}:
                yield (item,)
            return
        begins = [0]
        for w in line[1:-1].split(" "):
            begins.append(begins[-1] + len(w) + 1)
        number = {b: k for k, b in enumerate(begins)}
        runs: dict[tuple[int, int], list[int]] = {}
        for end, (size, where) in found:
            first = number[end - size + 1]
            for item, k in where:
                runs.setdefault((item, first - k), []).append(first)
        at = word_spans(text, form)
        for (item, _), firsts in sorted(runs.items()):
            firsts.sort()
            start = prev = firsts[0]
            for f in [*firsts[1:], None]:
                if f is None or f > prev + min_words:
                    last = prev + min_words - 1
                    yield item, start, last - start + 1, at[start][1], at[min(last, len(at) - 1)][2]
                    start = f
                prev = f

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, spell = shared.value
        form = form_of(spell)
        automaton = _automaton_of(name, items, min_words, form)
        for batch in batches:
            rows = []
            if automaton is not None:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if text and doc is not None:
                        rows += [(doc, *h) for h in hits(text, automaton, form)]
            columns = list(zip(*rows, strict=True)) or [[]] * (6 if spans else 2)
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * (4 if spans else 0)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def leaked_passages(df: DataFrame, items: DataFrame, min_words: int = 12, vocabulary: tuple[str, ...] = (), spans: bool = False, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "item_text") -> DataFrame:
    """``(doc_id, item_id)`` of texts that hold ``min_words`` consecutive words of an item; with ``spans`` one row per passage, adding
    ``first_word, n_words`` (in the text's words) and ``char_start, char_end`` (in the stored text).

    Nulls, empty texts, empty tables and items shorter than ``min_words`` give no rows; repeated rows give the pair once. The items
    (held-out tests, a small fixed set) are read by the driver in blocks of ``ITEMS_PER_PASS``, one pass over the corpus each; the corpus is
    never shuffled, only the found pairs are.
    """
    spellings = vocabulary_spellings(*vocabulary)
    listed = items.select(F.col(item_col).cast("long"), F.col(item_text_col).cast("string")).dropna().distinct().toLocalIterator()
    out, block = None, []

    def flush() -> None:
        nonlocal out, block
        found = _scan(df, block, min_words, spellings, id_col, text_col, spans)
        out, block = found if out is None else out.union(found), []

    for item in listed:
        block.append((item[0], item[1]))
        if len(block) >= ITEMS_PER_PASS:
            flush()
    if block or out is None:
        flush()
    return out.distinct()
