"""Byte-pair encoding by a deterministic tokenization automaton.

The automaton accepts exactly the token sequences that the merges produce. It is built as in Berglund, Martens and van
der Merwe, "Constructing a BPE Tokenization DFA" (2024): start with one state that loops over all bytes, and for each merge
(a, b) add a gadget in which, after ``a``, ``b`` may no longer follow while the new token may stand wherever ``a`` could. As the
state reached depends on the last token only, a state is named by that token, and a gadget is one cut (a, b) with its time.
A token may follow another unless some left part of the one was cut after some right part of the other before both were built.

Encoding reads a pre-split word once, byte by byte: trie arcs give the tokens that end at each byte, and the automaton's table says
which of them may follow the single token that ends where they begin. The arcs are filled into the table when first met.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Splits text before merging (fixed value of the public byte-level vocabularies).
PRE_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
START = -1
#: A worker forgets its words at this count, so that its memory stays bounded; results don't depend on it.
MEMO_WORDS = 400_000
#: Arcs that a worker's table holds; it is filled anew beyond that.
MEMO_ARCS = 4_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a ``.tiktoken`` rank file or of a byte-level ``.json`` vocabulary."""
    if path.endswith(".json"):
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        merged = {"".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]}
        return {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if t in merged or len(t) == 1 and t in back}
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class TokenizationAutomaton:
    """States are last tokens; ``START`` begins a word. ``ids`` are the vocabulary's own."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.label = {i: t for t, i in ranks.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        #: (a, b) -> time of the gadget that cut b after a
        self.cut: dict[tuple[int, int], int] = {}
        self.born: dict[int, int] = {i: -1 for t, i in ranks.items() if len(t) == 1}
        self.arcs: dict[int, bool] = {}
        for token, i in sorted(((t, i) for t, i in ranks.items() if len(t) > 1), key=lambda x: x[1]):
            self._gadget(token, i)
        self._index()

    def _gadget(self, token: bytes, i: int) -> None:
        """Merge number ``i``: find the two parts as the earlier gadgets spell the new token, cut one after the other, add its arc."""
        path = self._spell(token, i)
        if len(path) != 2:
            return  # no earlier state has an arc for its parts: the token is unreachable
        a, b = path
        self.cut[a, b] = i
        self.left[i], self.right[i], self.born[i] = a, b, i

    def _spell(self, token: bytes, before: int) -> list[int]:
        """The parts that the merges older than ``before`` leave of ``token``."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 1:
            best, at = before, -1
            for k in range(len(parts) - 1):
                r = self.ranks.get(parts[k] + parts[k + 1], before)
                if r < best:
                    best, at = r, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _index(self) -> None:
        """Trie over the reachable tokens: (node, byte) -> node, and the token that ends at a node."""
        self.next: dict[int, int] = {}
        self.ends: list[int] = [START]
        for i in self.born:
            node = 0
            for byte in self.label[i]:
                key = node << 8 | byte
                if key not in self.next:
                    self.next[key] = len(self.ends)
                    self.ends.append(START)
                node = self.next[key]
            self.ends[node] = i

    def follows(self, state: int, token: int) -> bool:
        """Whether the automaton has an arc labelled ``token`` out of ``state``.

        Walk the right parts of ``state`` against the left parts of ``token``: the arc is missing if a gadget cut this pair of parts
        before the later of the two wholes they belong to was built.
        """
        if state == START:
            return True
        key = state << 32 | token
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= MEMO_ARCS:
                self.arcs.clear()
            known = self.arcs[key] = self._follows(state, token)
        return known

    def _follows(self, state: int, token: int) -> bool:
        never = 1 << 60
        s, s_until = state, never
        while True:
            t, t_until = token, never
            while True:
                time = self.cut.get((s, t))
                # equal merges go from left to right: before a part joins to its right, but after it has joined to its left
                if time is not None and time < s_until and time <= t_until:
                    return False
                if t not in self.left:
                    break
                t_until, t = self.born[t], self.left[t]
            if s not in self.right:
                return True
            s_until, s = self.born[s], self.right[s]

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-split word."""
        n = len(word)
        whole = self.ranks.get(word, START)
        if whole in self.born:
            return [whole]
        last, came = [START] * (n + 1), [0] * (n + 1)
        met = [True] + [False] * n
        nxt, ends, follows = self.next, self.ends, self.follows
        for i in range(n):
            if not met[i]:
                continue
            node, state = 0, last[i]
            for j in range(i, n):
                node = nxt.get(node << 8 | word[j], 0)
                if not node:
                    break
                token = ends[node]
                if token >= 0 and not met[j + 1] and follows(state, token):
                    last[j + 1], came[j + 1], met[j + 1] = token, i, True
        out, i = [], n
        while i:
            out.append(last[i])
            i = came[i]
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> str:
        """The text that the arc labels spell."""
        return b"".join(self.label[i] for i in ids).decode("utf-8", errors="replace")


class WordEncoder:
    """Pre-split and encode whole texts, remembering words."""

    def __init__(self, automaton: TokenizationAutomaton, pattern: str = PRE_SPLIT):
        self.automaton, self.split, self.memo = automaton, regex.compile(pattern).findall, {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memo, out = self.memo, []
        for word in self.split(text):
            ids = memo.get(word)
            if ids is None:
                ids = self.automaton.encode_word(word.encode("utf-8", errors="replace"))
                if len(word) <= 64:
                    if len(memo) >= MEMO_WORDS:
                        memo.clear()
                    memo[word] = ids
            out += ids
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encode_corpus(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PRE_SPLIT) -> DataFrame:
    """``(id_col, ids array<int>)``, one row for each row of ``df``, without a shuffle.

    ``vocabulary`` is the path of a byte-level rank file, read by the driver; its size is that of the vocabulary, not of the data.
    Null and empty texts give an empty list; the text is taken as it is, special tokens' strings being ordinary text. Repeated
    rows and null ids are kept; other columns are not read.
    """
    ranks = load_ranks(vocabulary)
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    name = f"{vocabulary}:{len(ranks)}:{pattern}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ENCODERS:
            _ENCODERS[name] = WordEncoder(TokenizationAutomaton(shared.value), pattern)
        encode = _ENCODERS[name].encode
        for batch in batches:
            ids = [encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_corpus(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The inverse of :func:`encode_corpus`: ``(id_col, text)``; null or empty lists give an empty text."""
    shared = df.sparkSession.sparkContext.broadcast({i: t for t, i in load_ranks(vocabulary).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = shared.value
        for batch in batches:
            texts = [b"".join(label[i] for i in ids or []).decode("utf-8", errors="replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
