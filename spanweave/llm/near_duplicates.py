"""Near-duplicate records by deletion-variant signatures.

A record is the set of its word shingles, sketched by a vector of min-wise hashes; two vectors agree in each symbol with the sets'
Jaccard similarity. As in HmSearch (Zhang, Qin, Wang, Sun, Lu 2013), the vector is cut into segments, each segment is indexed under its
variants with one symbol deleted, so that segments which differ by at most one symbol meet, records with an equal variant are candidates, and
candidates are verified on the whole sets. At a low similarity two vectors may differ in more symbols than there are segments, so that such a
segment is likely but not certain: the loss below is what remains.

A symbol has 16 bits instead of one: single min-hash bits agree by chance in half of all cases, so at a similarity of 0.5 a
segment within one bit selects nothing. With 16 segments of 4 symbols a pair at similarity 0.5 is missed with probability (1 - 0.3125)^16 = 0.0025, at 0.6
with 0.00003.

Equal sets are collapsed first: however many copies a text has, it is signed, joined and verified once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.operators.components import connected_components
from spanweave.session import materialize

_RUN = re.compile(r"[^\W_]+")
_MEMO_WORDS = 500_000
#: Rows of one key that a scan pairs up itself; keys with more go through a join, which splits them over tasks.
RUN_ROWS = 1000
#: Up to this many ids (8 MB) are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value: the odd golden-ratio multiplier


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64's constants, fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Codes(dict):
    """Word -> 64-bit code of its lower case; forgets when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO_WORDS:
            self.clear()
        code = self[word] = int.from_bytes(hashlib.blake2b(word.lower().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return code


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """(ids, texts) of a batch in parts of bounded size; a very long text is a part of its own."""
    ids, texts, size = [], [], 0
    for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if i is not None and text:
            ids.append(i)
            texts.append(text)
            size += len(text)
            if len(ids) == 4096 or size > 4_000_000:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _shingler(shingle: int, min_words: int):
    """texts -> (positions of those with enough words, sizes of their sets, sorted distinct 52-bit shingle hashes of one after the other).

    A text with fewer words than a shingle has one shingle of all its words; one without words has none and is left out.
    """
    codes = _Codes()

    def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        runs = [_RUN.findall(t) for t in texts]
        kept = np.array([k for k, w in enumerate(runs) if w and len(w) >= min_words], np.int64)
        if not len(kept):
            return kept, kept, np.empty(0, np.uint64)
        lengths = np.array([len(runs[k]) for k in kept])
        c = np.array([code for k in kept for code in map(codes.__getitem__, runs[k])], np.uint64)
        owner = np.repeat(np.arange(len(kept), dtype=np.uint64), lengths)
        h, last = np.zeros(len(c), np.uint64), len(c) - 1
        at = np.arange(len(c))
        ends = np.cumsum(lengths)[owner.astype(np.int64)]
        for k in range(shingle):
            # past a text's end nothing is added, so a short text's only shingle is the one at its start
            h = np.where(at + k < ends, _mixed(h * _MIX + c[np.minimum(at + k, last)]), h)
        whole = (at + shingle <= ends) | (at == ends - lengths[owner.astype(np.int64)])
        keyed = np.sort((owner[whole] << np.uint64(52)) | (h[whole] >> np.uint64(12)))
        keyed = keyed[np.concatenate([[True], keyed[1:] != keyed[:-1]])]
        return kept, np.bincount((keyed >> np.uint64(52)).astype(np.int64), minlength=len(kept)), keyed & np.uint64((1 << 52) - 1)

    return shingles


def _signer(shingle: int, min_words: int, symbols: int, seed: int):
    salts = np.random.default_rng(seed).integers(1, 1 << 63, size=symbols, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = _shingler(shingle, min_words)
        for batch in batches:
            for ids, texts in _chunks(batch):
                kept, sizes, flat = shingles(texts)
                if not len(kept):
                    continue
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                sketch = np.empty((len(kept), symbols), np.uint16)
                for k, salt in enumerate(salts):
                    y = flat * salt
                    y ^= y >> np.uint64(32)
                    sketch[:, k] = _mixed(np.minimum.reduceat(y, starts)) & np.uint64(0xFFFF)
                raw = flat.tobytes()
                digests = [hashlib.blake2b(raw[8 * a : 8 * (a + n)], digest_size=16).digest() for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                cols = [pa.array([ids[k] for k in kept], pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes.astype(np.int32)), pa.array([row.tobytes() for row in sketch], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "digest", "n", "sketch"])

    return run


def _variants(segments: int, width: int, seed: int):
    """sketch -> a row for each segment variant that lacks one symbol: ``(key, id)``."""
    slot = np.random.default_rng(seed + 1).integers(1, 1 << 63, size=(segments, width), dtype=np.uint64) | np.uint64(1)
    place = (_MIX * (np.arange(segments * width, dtype=np.uint64) + np.uint64(1))).reshape(segments, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            symbols = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).astype(np.uint64).reshape(n, segments, width)
            mixed = _mixed((symbols + np.uint64(1)) * slot[None])
            keys = _mixed(mixed.sum(axis=2, dtype=np.uint64)[:, :, None] - mixed + place[None])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), segments * width))], names=["key", "id"])

    return run


def _sets(shingle: int, min_words: int):
    """text -> ``(id, shingles)`` with 32 bits of each hash, by which a similarity is off by at most the set's size over 2**32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = _shingler(shingle, min_words)
        for batch in batches:
            for ids, texts in _chunks(batch):
                kept, sizes, flat = shingles(texts)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in kept], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.uint32).view(np.int32)))], names=["id", "shingles"])

    return run


@dataclass
class Signed:
    """A signed table: its rows, one row per signed id and one row per distinct set."""

    rows: DataFrame  # id, text
    members: DataFrame  # id, class_id
    classes: DataFrame  # class_id, n, sketch
    shingle: int
    min_words: int
    segments: int
    width: int
    seed: int
    held: list[DataFrame]

    def keyed(self) -> DataFrame:
        """``(key, id)``: a row for each class and variant of its segments."""
        return self.classes.select("class_id", "sketch").mapInArrow(_variants(self.segments, self.width, self.seed), "key long, id long")

    def close(self) -> None:
        """Give the cached tables back; what has been materialised stays."""
        for df in self.held:
            df.unpersist()


def sign(df: DataFrame, id_col: str, text: Column, shingle: int = 5, min_words: int = 0, segments: int = 16, width: int = 4, seed: int = 7) -> Signed:
    """Sign every row with a word and at least ``min_words`` of them. Equal sets form a class, named by its smallest id; only it keeps a sketch."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.cast("string").alias("text"))
    signed = rows.mapInArrow(_signer(shingle, min_words, segments * width, seed), "id long, digest binary, n int, sketch binary").persist(StorageLevel.MEMORY_AND_DISK)
    classes = signed.groupBy("digest").agg(F.min("id").alias("class_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).persist(StorageLevel.MEMORY_AND_DISK)
    members = materialize(signed.select("id", "digest").distinct().join(classes.select("digest", "class_id"), "digest").select("id", "class_id"))
    return Signed(rows, members, classes.select("class_id", "n", "sketch"), shingle, min_words, segments, width, seed, [signed, classes])


def _verified(signed: Signed, found: DataFrame, similarity: float) -> DataFrame:
    """``found(a, b)`` -> ``(a, b, likeness)`` of those whose sets share ``similarity`` of their union.

    Candidates whose sizes rule them out go before sets are made, again from the texts, for what is left only.
    """
    sized = found.join(signed.classes.select(F.col("class_id").alias("a"), F.col("n").alias("na")), "a").join(signed.classes.select(F.col("class_id").alias("b"), F.col("n").alias("nb")), "b")
    candidates = materialize(sized.where((F.col("na") >= similarity * F.col("nb")) & (F.col("nb") >= similarity * F.col("na"))))
    ends = materialize(candidates.select(F.col("a").alias("id")).union(candidates.select("b")).distinct())
    wanted = F.broadcast(ends) if ends.count() <= BROADCAST_IDS else ends
    texts = signed.rows.join(wanted, "id", "left_semi").mapInArrow(_sets(signed.shingle, signed.min_words), "id long, shingles array<int>").dropDuplicates(["id"])
    texts = texts.persist(StorageLevel.MEMORY_AND_DISK)
    pairs = candidates.join(texts.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(texts.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    measured = pairs.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("c"))
    out = materialize(measured.select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("likeness")).where(F.col("likeness") >= similarity))
    texts.unpersist()
    return out


def _runs(star: bool):
    """Over rows (key, id) sorted by both: pairs ``(a, b)`` of ids with one key, a < b; with ``star`` only those with the key's smallest id.

    Without it, a key of more than ``RUN_ROWS`` rows gives ``(key, null)`` instead.
    """

    def pairs(key: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, lag = np.arange(len(key)), 0
        while len(at):
            lag += 1
            at = at[at + lag < len(key)]
            at = at[key[at] == key[at + lag]]
            here = at[ids[at] != ids[at + lag]]
            yield from out(ids[here], ids[here + lag])

    def out(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, skipped, least = np.empty(0, np.int64), np.empty(0, np.int64), None, None
        for batch in batches:
            k, i = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if star:
                if not len(k):
                    continue
                first = np.concatenate([[True], k[1:] != k[:-1]])
                low = i[np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))]
                if least is not None and least[0] == k[0]:
                    low[: np.searchsorted(k, k[0], side="right")] = least[1]
                least = (k[-1], low[-1])
                yield from out(low[low != i], i[low != i])
                continue
            key, ids = np.concatenate([key, k]), np.concatenate([ids, i])
            if skipped is not None:
                rest = key != skipped
                key, ids = key[rest], ids[rest]
            if not len(key):
                continue
            cut = np.searchsorted(key, key[-1])  # the last run may go on
            sizes = np.diff(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])))
            long = np.repeat(sizes > RUN_ROWS, sizes)
            if long.any():
                hot = np.unique(key[long])
                yield pa.RecordBatch.from_arrays([pa.array(hot), pa.nulls(len(hot), pa.int64())], names=["a", "b"])
                if long[-1]:
                    skipped = key[-1]
            done = ~long & (np.arange(len(key)) < cut)
            yield from pairs(key[done], ids[done])
            tail = ~long & (np.arange(len(key)) >= cut)
            key, ids = key[tail], ids[tail]
        yield from pairs(key, ids)

    return run


def class_links(signed: Signed, similarity: float) -> DataFrame:
    """``(a, b, likeness)``, a < b, for all found pairs of classes whose sets share ``similarity`` of their union.

    The equality join on the variants' key is one exchange of rows of two numbers, sorted and scanned for runs; keys with many rows are joined
    apart, where AQE splits their rows over tasks. No key is capped.
    """
    keyed = signed.keyed()
    met = materialize(keyed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_runs(False), "a long, b long").distinct())
    found, hot = met.where("b is not null"), met.where("b is null").select(F.col("a").alias("key"))
    if not hot.isEmpty():
        rows = materialize(keyed.join(hot, "key", "left_semi"))
        a, b = rows.alias("a"), rows.alias("b")
        joined = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")))
        found = materialize(found.union(joined.select(F.col("a.id"), F.col("b.id"))).distinct())
    return _verified(signed, found, similarity)


def class_chains(signed: Signed, similarity: float) -> DataFrame:
    """``(node, component)`` of the classes that have a link: the chains of :func:`class_links` without all the links inside a dense group.

    Every class is compared with the smallest one of each of its keys first. What these links join is one chain already, so after that only pairs from different
    chains are compared.
    """
    keyed = signed.keyed()
    star = materialize(keyed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_runs(True), "a long, b long").distinct())
    first = _verified(signed, star, similarity)
    chains = materialize(connected_components(first.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    placed = keyed.join(chains.withColumnRenamed("node", "id"), "id", "left").withColumn("chain", F.coalesce("component", "id")).select("key", "id", "chain")
    open_ = placed.join(placed.groupBy("key").agg(F.min("chain").alias("lo"), F.max("chain").alias("hi")).where("lo < hi").select("key"), "key", "left_semi")
    open_ = materialize(open_)
    a, b = open_.alias("a"), open_.alias("b")
    across = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.chain") < F.col("b.chain"))).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()
    rest = _verified(signed, materialize(across.join(star, ["a", "b"], "left_anti")), similarity)
    return connected_components(first.union(rest).select(F.col("a").alias("src"), F.col("b").alias("dst")))


def near_duplicate_pairs(df: DataFrame, id_col: str, text: Column, similarity: float = 0.8, shingle: int = 5, min_words: int = 0, **sketch: int) -> DataFrame:
    """``(id_col_a, id_col_b, likeness)``, a < b: every pair of records whose shingle sets share ``similarity`` of their union, copies included.

    An id delivered twice counts once. Texts without words or with fewer than ``min_words`` and null ids have no pair; a text with fewer words than a
    shingle has all its words as its only shingle. An empty table gives no rows. The number of rows is that of the pairs asked for;
    :func:`near_duplicate_groups` gives one row per record instead.
    """
    signed = sign(df, id_col, text, shingle, min_words, **sketch)
    links = class_links(signed, similarity)
    signed.close()
    member = signed.members
    across = links.join(member.select(F.col("class_id").alias("a"), F.col("id").alias("x")), "a").join(member.select(F.col("class_id").alias("b"), F.col("id").alias("y")), "b").select("x", "y", "likeness")
    m, o = member.alias("m"), member.alias("o")
    within = m.join(o, (F.col("m.class_id") == F.col("o.class_id")) & (F.col("m.id") < F.col("o.id"))).select(F.col("m.id").alias("x"), F.col("o.id").alias("y"), F.lit(1.0).alias("likeness"))
    both = across.union(within).where("x <> y")
    return both.groupBy(F.least("x", "y").alias(f"{id_col}_a"), F.greatest("x", "y").alias(f"{id_col}_b")).agg(F.max("likeness").alias("likeness"))


def near_duplicate_groups(df: DataFrame, id_col: str, text: Column, similarity: float = 0.8, shingle: int = 5, min_words: int = 0, **sketch: int) -> DataFrame:
    """``(id_col, class_id, group_id)``: one row per record (a distinct id that isn't null).

    ``class_id`` names the records with the same shingle set, ``group_id`` the smallest id of the chain of similar classes. A record without
    words, or with fewer than ``min_words``, is a class and group of its own. Nothing is expanded into pairs of copies, nor into all pairs of a chain.
    """
    signed = sign(df, id_col, text, shingle, min_words, **sketch)
    chains = materialize(class_chains(signed, similarity))
    signed.close()
    placed = signed.members.join(chains.withColumnRenamed("node", "class_id"), "class_id", "left").select("id", "class_id", F.coalesce("component", "class_id").alias("group_id"))
    # an id whose deliveries differ has a row in each class: the first is kept
    one = placed.groupBy("id").agg(F.min(F.struct("class_id", "group_id")).alias("c"))
    every = signed.rows.select("id").where("id is not null").distinct()
    return every.join(one, "id", "left").select(F.col("id").alias(id_col), F.coalesce("c.class_id", "id").alias("class_id"), F.coalesce("c.group_id", "id").alias("group_id"))
