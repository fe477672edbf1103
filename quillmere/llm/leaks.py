"""Problem 9: evaluation texts leaking into training text.

Method: spaced-seed hashing.  Fixed masks look at four of five to seven successive words and ignore
the others, so that a changed word breaks only the seeds that look at it.  The seeds of the test
items and of the documents are joined by hash; around the hits of one document and item that lie
close to one diagonal, the longest common subsequence of the item and that place of the document
tolerates substitutions and an insertion, and at least half of the item's words must be in it.

A seed of four words can't find what is left of a short item.  For items under ``SHORT`` words every
word is a seed of its own, but those of the most frequent words aren't needed: who holds half of n
words holds one of any n // 2 + 1, so the rarest of these are enough, and the way is exact.

Up to ``FEW_WORDS`` words of items go to the workers, which join the seeds in one pass over the
documents; only found pairs move.  Of more items the seeds of both sides are rows and are joined by
hash, documents are read once as well, and the pairs with enough hits meet their texts again.  Both
ways give the same rows.

Words are runs of letters and digits of the text in lower case, in compatibility form, with tags
and invisible characters removed and words that a line end divides put together again.

Defined cases: null and empty texts and passages, and passages without a word, match nothing; half of
one word is that word; equal items are all reported; a document that holds an item several times has one row;
repeated rows count once.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.plans.cut import cut

#: Positions that each mask looks at.
MASKS = ((0, 1, 3, 4), (0, 2, 3, 5), (0, 1, 2, 4), (0, 3, 4, 6), (0, 2, 4, 6))
SPAN = 8
#: Words of all items that may go to the workers.
FEW_WORDS = 1_000_000
#: Items of fewer words are found by single words.
SHORT = 24
#: Width in words of the diagonals that count as one place; it bounds an insertion (by the item's length, if that is less).
PLACE = 24
#: Hits that a place of a longer item needs.
MIN_HITS = 3

_BROKEN = re.compile(r"([^\W_])(?:-|­)[ \t]*\r?\n[ \t>|*]*([^\W_])")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--(?:(?!<!--).)*?-->", re.S)
_UNSEEN = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _UNSEEN.sub("", text.replace("­\n", "-\n")))
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(_BROKEN.sub(r"\1\2", text).lower())


def seed_keys(ids: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the seeds of which every looked-at word is known."""
    n = len(ids) - SPAN
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(np.logical_and.reduce([ids[k : n + k] > 0 for k in mask]))
    key = np.zeros(len(at), np.uint64)
    for k in mask:
        key = (key ^ ids[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return at, key


def rare_places(ids: list[int], count: dict[int, int]) -> list[int]:
    """Places of an item of which one is held by whoever holds half of it: those of the words that are rarest among items."""
    return sorted(range(len(ids)), key=lambda k: (count[ids[k]], ids[k], k))[: len(ids) // 2 + 1]


def bits_of(ids: list[int]) -> dict[int, int]:
    bits: dict[int, int] = {}
    for k, w in enumerate(ids):
        bits[w] = bits.get(w, 0) | 1 << k
    return bits


def common(bits: dict[int, int], n: int, part: list[int]) -> int:
    """Length of the longest common subsequence of an item of n words and ``part``, by bits."""
    full = (1 << n) - 1
    row = full
    for w in part:
        u = row & bits.get(w, 0)
        row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def holds(bits: dict[int, int], n: int, diagonals: np.ndarray, ids: np.ndarray) -> bool:
    """Whether at least half of an item's words stand in order in one place round its hits; the diagonals are sorted."""
    if n < SHORT:
        slack, done = min(PLACE, n), -1 << 60
        for d in diagonals.tolist():
            low, high = max(0, d - slack), d + n + slack
            if d != done and 2 * common(bits, n, ids[low:high].tolist()) >= n:
                return True
            done = d
        return False
    ends = np.searchsorted(diagonals, diagonals + PLACE, side="right")
    tried: set[tuple[int, int]] = set()
    for lo in np.argsort(np.arange(len(diagonals)) - ends, kind="stable"):
        hi = int(ends[lo])
        if hi - lo < MIN_HITS:
            return False
        low, high = max(0, int(diagonals[lo]) - 2), int(diagonals[hi - 1]) + n + 2
        if any(abs(low - x) + abs(high - y) < PLACE for x, y in tried):
            continue
        tried.add((low, high))
        if 2 * common(bits, n, ids[low:high].tolist()) >= n:
            return True
    return False


class Seeds:
    """The seeds of items that fit into a worker."""

    def __init__(self, items: list[tuple[int, str]]):
        self.table: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item, passage in items:
            ids = [self.table.setdefault(w, len(self.table) + 1) for w in words(passage or "")]
            if ids:
                self.items.append((item, np.array(ids, np.int64)))
        self.bits = [bits_of(ids.tolist()) for _, ids in self.items]
        self.masks = []
        for mask in MASKS:
            keys, owner, place = [], [], []
            for k, (_, ids) in enumerate(self.items):
                if len(ids) >= SHORT:
                    at, key = seed_keys(np.concatenate([ids, np.zeros(SPAN, np.int64)]), mask)
                    keys.append(key)
                    owner.append(np.full(len(at), k))
                    place.append(at)
            self._add(mask, keys, owner, place)
        count = Counter(w for _, ids in self.items if len(ids) < SHORT for w in set(ids.tolist()))
        keys, owner, place = [], [], []
        for k, (_, ids) in enumerate(self.items):
            if len(ids) < SHORT:
                at = np.array(rare_places(ids.tolist(), count), np.int64)
                keys.append(ids[at].astype(np.uint64))
                owner.append(np.full(len(at), k))
                place.append(at)
        self._add((), keys, owner, place)

    def _add(self, mask: tuple[int, ...], keys: list, owner: list, place: list) -> None:
        if keys:
            key = np.concatenate(keys)
            order = np.argsort(key, kind="stable")
            self.masks.append((mask, *np.unique(key[order], return_index=True, return_counts=True), np.concatenate(owner)[order], np.concatenate(place)[order]))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document positions, items, item positions) of the equal seeds."""
        found = []
        for mask, unique, first, count, owner, place in self.masks:
            at, key = seed_keys(ids, mask) if mask else (np.arange(len(ids)), ids.astype(np.uint64))
            if not len(key):
                continue
            where = np.minimum(np.searchsorted(unique, key), len(unique) - 1)
            equal = unique[where] == key
            at, where = at[equal], where[equal]
            n = count[where]
            index = np.repeat(first[where] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(n.sum())
            found.append((np.repeat(at, n), owner[index], place[index]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))

    def held(self, ids: np.ndarray) -> list[int]:
        """Ids of the items of which a document with these words holds at least half."""
        at, item, place = self.hits(np.concatenate([ids, np.zeros(SPAN, np.int64)]))
        if not len(at):
            return []
        diagonal = at - place
        order = np.lexsort((diagonal, item))
        item, diagonal = item[order], diagonal[order]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(item)) + 1, [len(item)]])
        return [self.items[k][0] for a, b in zip(edges[:-1], edges[1:]) if holds(self.bits[k := int(item[a])], len(self.items[k][1]), diagonal[a:b], ids)]


def _few(documents: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    shipped = documents.sparkSession.sparkContext.broadcast(items)  # at most FEW_WORDS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds(shipped.value)
        known = seeds.table.get
        for batch in batches:
            docs, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([known(w, 0) for w in words(text)], np.int64)
                if ids.any():
                    for item in seeds.held(ids):
                        docs.append(doc)
                        found.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "item_id"])

    return documents.mapInArrow(run, "doc_id bigint, item_id bigint").distinct()


def _seeds(texts: DataFrame, singles: DataFrame | None) -> DataFrame:
    """(row, seed, at): the seeds of whole texts, and their single words if short items need them."""
    every = singles is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = _hashed(words(text))
                parts = [seed_keys(np.concatenate([ids, np.zeros(SPAN, np.int64)]), mask) for mask in MASKS]
                seed = np.concatenate([(k ^ np.uint64(n + 1)).view(np.int64) for n, (_, k) in enumerate(parts)] + ([ids] if every else []))
                at = np.concatenate([a for a, _ in parts] + ([np.arange(len(ids))] if every else []))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row)), pa.array(seed), pa.array(at)], names=["row", "seed", "at"])

    return texts.mapInArrow(run, "row bigint, seed bigint, at bigint")


def _hashed(ws: list[str]) -> np.ndarray:
    return np.array([(xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) >> 1) | 1 for w in ws], np.int64)


def _many(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The same by a join of the seeds as rows."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ws = [_hashed(words(p)) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ws, pa.list_(pa.int64()))], names=["item_id", "words"])

    texts = cut(documents.groupBy("doc_id", F.xxhash64("text").alias("key")).agg(F.first("text").alias("text")).withColumn("row", F.monotonically_increasing_id()), "texts")
    passages = cut(items.mapInArrow(lengths, "item_id bigint, words array<bigint>").where(F.size("words") > 0).withColumn("item", F.monotonically_increasing_id()), "passages")
    short = passages.where(F.size("words") < SHORT)
    counts = short.select(F.explode(F.array_distinct("words")).alias("seed")).groupBy("seed").count()
    of_word = short.select("item", F.size("words").alias("n"), F.posexplode("words").alias("place", "seed")).join(counts, "seed")
    order = Window.partitionBy("item").orderBy("count", "seed", "place")  # at most SHORT rows
    single = of_word.withColumn("k", F.row_number().over(order)).where("k <= n div 2 + 1").select("item", "seed", "place", F.lit(True).alias("short"))
    long = items.join(passages.where(F.size("words") >= SHORT).select("item_id", "item"), "item_id")
    of_long = _seeds(long.select(F.col("item").alias("row"), F.col("passage").alias("text")), None)
    wanted = of_long.select(F.col("row").alias("item"), "seed", F.col("at").alias("place"), F.lit(False).alias("short")).union(single)
    on = _seeds(texts.select("row", "text"), single)
    hits = on.join(wanted, "seed").groupBy("row", "item", "short", (F.col("at") - F.col("place")).alias("d")).agg(F.count("*").alias("n"))
    # of one pair there are at most as many diagonals as the text and the item have words
    pairs = hits.groupBy("row", "item", "short").agg(F.sum("n").alias("hits"), F.collect_list(F.struct("d", "n")).alias("d"))
    pairs = pairs.where(F.col("short") | (F.col("hits") >= MIN_HITS)).select("row", "item", F.expr("sort_array(d).d").alias("d"), F.expr("sort_array(d).n").alias("n"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids = None, np.zeros(0, np.int64)
        for batch in batches:
            good = []
            for row, text, held, d, n in zip(*(c.to_pylist() for c in batch.columns[2:])):
                if row != last:
                    last, ids = row, _hashed(words(text))
                good.append(holds(bits_of(held), len(held), np.repeat(np.array(d, np.int64), n), ids))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["doc_id", "item_id"])

    both = pairs.join(passages, "item").join(texts, "row").select("doc_id", "item_id", "row", "text", "words", "d", "n")
    return both.mapInArrow(verify, "doc_id bigint, item_id bigint").distinct()


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): the items of which a document holds at least half of the words, in order and in one place."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(
        "doc_id is not null and length(text) > 0"
    )
    passages = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("passage").cast("string").alias("passage")).where(
        "item_id is not null and length(passage) > 0"
    )
    passages = passages.distinct()
    most = passages.agg(F.sum(F.length("passage") / 2 + 1)).first()[0] or 0  # a word and its end are two characters at least
    if most > FEW_WORDS:
        return _many(texts, passages)
    return _few(texts, [(r["item_id"], r["passage"]) for r in passages.collect()])
