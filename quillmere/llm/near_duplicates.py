"""Problem 3: near-duplicate records with small edits.

Method: sequential Bayesian verification.  Every text gets a min-hash signature of its word
shingles; bands of it propose candidates; of a candidate pair the signatures are compared batch by
batch, and a pair is dropped as soon as the posterior probability of a similarity at or above the
threshold, given the matches so far, falls under the chosen miss probability; the survivors are
verified exactly on the whole shingle sets.

* Texts with the same set of shingles are one class; only its representative is hashed into bands,
  so a class of copies, however large, costs one row, and is expanded at the end.
* Signatures and shingle sets are made in one pass over whole texts.  The bands, the candidates and
  the exact check are equi-joins on hashes and ids, which adaptive execution may split when skewed.
* Only band hashes and ids are joined to find candidates; signatures (16 bits a hash) follow for the
  distinct pairs.  Shingle sets are never stored: they are made again from the texts of the survivors.

Defined cases: null ids and null texts, and texts under ``min_words`` words, take no part; of a file
delivered again with another text the one ingested last counts; repeated rows count once; with equal
ingestion times the greater text hash counts; tables without pairs give no rows.  ``classes`` has a row for
every id: texts too short for a shingle are classed by the hash of the whole text, blank ones as one class
and files without any text as another, all without links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.plans.cut import cut

BANDS, BAND_ROWS, BATCH = 48, 4, 32
HASHES = BANDS * BAND_ROWS
MISS = 1e-4
#: Ids of survivors up to this number (8 bytes each) are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
CACHED_WORDS = 200_000
_WORD = re.compile("[a-z0-9]+")
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_WORDS: dict[str, int] = {}


def shingles(text: str, width: int) -> tuple[np.ndarray, int]:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words, and the number of words."""
    found = _WORD.findall(text.lower())
    table = _WORDS
    ids = np.empty(len(found), np.uint64)
    for k, w in enumerate(found):
        h = table.get(w)
        if h is None:
            if len(table) >= CACHED_WORDS:
                table.clear()
            h = table[w] = xxhash.xxh3_64_intdigest(w)
        ids[k] = h
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), len(found)
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key = (key ^ ids[k : n + k]) * _P1
        key ^= key >> np.uint64(31)
    key = key * _P2
    key ^= key >> np.uint64(29)
    return np.unique(key), len(found)


def signature(keys: np.ndarray) -> np.ndarray:
    """Min-hashes, as 16-bit numbers: different ones agree once in 65,536 times."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(keys), 2048):
        block = keys[at : at + 2048, None] * _MUL[None, :] + _ADD[None, :]
        least = np.minimum(least, block.min(0))
    return (least >> np.uint64(48)).astype(np.uint16)


def least_matches(threshold: float, miss: float = MISS) -> np.ndarray:
    """Matches that a pair must have after each batch: fewer leave P(similarity >= threshold) under ``miss``.

    With a uniform prior the posterior after m matches of n is Beta(m + 1, n - m + 1), and its mass
    from t upwards is the chance of at most m successes in n + 1 draws of probability t."""
    need = []
    for n in range(BATCH, HASHES + 1, BATCH):
        mass, m = 0.0, 0
        while True:
            mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= miss:
                break
            m += 1
        need.append(m)
    return np.array(need)


def rows_of(files: DataFrame, id_col: str, text_col: str, order_col: str | None) -> DataFrame:
    when = F.coalesce(F.unix_micros(F.col(order_col).cast("timestamp")), F.lit(0)) if order_col else F.lit(0)
    rows = files.select(F.col(id_col).cast("long").alias("id"), when.cast("long").alias("ingested"), F.col(text_col).cast("string").alias("text"))
    return rows.where("id is not null and text is not null")


def sketches(rows: DataFrame, width: int, min_words: int) -> DataFrame:
    """(id, ingested, text_key, set_key, signature) of every text; the last two are null with too few words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for file, when, text in zip(*(c.to_pylist() for c in batch.columns)):
                text_key = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass") if text.strip() else b"") >> 1
                keys, n = shingles(text, width)
                if n < min_words or not len(keys):
                    out.append((file, when, text_key, None, None))
                    continue
                raw = keys.tobytes()
                out.append((file, when, text_key, xxhash.xxh3_128_digest(raw), signature(keys).tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "ingested", "text_key", "set_key", "signature"]
            )

    return rows.mapInArrow(run, "id bigint, ingested bigint, text_key bigint, set_key binary, signature binary")


def sets(rows: DataFrame, width: int) -> DataFrame:
    """(id, set_key, shingles) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [shingles(text, width)[0].tobytes() for text in batch.column(1).to_pylist()]
            keys = pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), keys, pa.array(raw, pa.binary())], names=["id", "set_key", "shingles"])

    return rows.select("id", "text").mapInArrow(run, "id bigint, set_key binary, shingles binary")


def bands(signatures: DataFrame) -> DataFrame:
    """(band, id): one hash a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            if not len(ids):
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(ids), BANDS, BAND_ROWS).astype(np.uint64)
            key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _P2, (len(ids), 1))
            for k in range(BAND_ROWS):
                key = (key ^ sig[:, :, k]) * _P1
                key ^= key >> np.uint64(31)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, BANDS))], names=["band", "id"]
            )

    return signatures.select("id", "signature").mapInArrow(run, "band bigint, id bigint")


def prune(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose signatures (sa, sb) survive every batch."""
    need = least_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(n, HASHES) for k in (2, 3)]
            alive, matches = np.arange(n), np.zeros(n, np.int64)
            for k, least in enumerate(need):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches = matches + (sig[0][alive, part] == sig[1][alive, part]).sum(1)
                keep = matches >= least
                alive, matches = alive[keep], matches[keep]
            index = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index)], names=["a", "b"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def verify(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs at or above the threshold, from the whole shingle sets (ka, kb)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[tuple[int, int, float]] = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.intersect1d(x, y, assume_unique=True).size
                either = len(x) + len(y) - both
                if both >= threshold * either - 1e-9:
                    got.append((a, b, both / either))
            columns = list(zip(*got)) if got else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                names=["a", "b", "similarity"],
            )

    return pairs.select("a", "b", "ka", "kb").mapInArrow(run, "a bigint, b bigint, similarity double")


class NearDuplicates:
    """``members`` (id, class), ``short`` (id, text_key) of the texts that take no part, and ``pairs`` (a, b, similarity) between class
    representatives."""

    def __init__(
        self,
        files: DataFrame,
        threshold: float = 0.8,
        width: int = 5,
        min_words: int = 1,
        id_col: str = "file_id",
        text_col: str = "content",
        order_col: str | None = "ingested_at",
    ):
        rows = rows_of(files, id_col, text_col, order_col)
        every = cut(sketches(rows, width, min_words), "sketches")
        last = every.groupBy("id").agg(F.max(F.struct("ingested", "text_key", "set_key")).alias("x"))
        self.short = last.where("x.set_key is null").select("id", F.col("x.text_key").alias("text_key"))
        current = last.select("id", F.col("x.set_key").alias("set_key")).where("set_key is not null")
        classes = current.groupBy("set_key").agg(F.min("id").alias("class"))
        self.members = cut(current.join(classes, "set_key").select("id", "class"), "members")
        kept = cut(
            every.join(classes.withColumnRenamed("class", "id"), ["id", "set_key"]).select("id", "set_key", "signature").dropDuplicates(["id"]),
            "classes",
        )
        hashed = bands(kept)
        pairs = (
            hashed.select("band", F.col("id").alias("a"))
            .join(hashed.select("band", F.col("id").alias("b")), "band")
            .where("a < b")
            .select("a", "b")
            .distinct()
        )
        signed = kept.select("id", "signature")
        signed = pairs.join(signed.toDF("a", "sa"), "a").join(signed.toDF("b", "sb"), "b")
        survivors = cut(prune(signed, threshold), "survivors")
        wanted = cut(survivors.select(F.col("a").alias("id")).union(survivors.select("b")).distinct(), "wanted")
        small = wanted.count() <= BROADCAST_IDS
        texts = rows.select("id", "text").join(F.broadcast(wanted) if small else wanted, "id", "left_semi")
        keys = kept.select("id", "set_key").join(wanted, "id", "left_semi")
        known = sets(texts, width).join(keys, ["id", "set_key"]).select("id", "shingles").dropDuplicates(["id"])
        known = cut(known, "sets")
        whole = survivors.join(known.toDF("a", "ka"), "a").join(known.toDF("b", "kb"), "b")
        self.pairs = cut(verify(whole, threshold), "pairs")


def found(files: DataFrame) -> DataFrame:
    """(file_a, file_b): every pair of different files of at least 50 words with a similarity of 0.6 or more."""
    near = NearDuplicates(files, threshold=0.6, width=3, min_words=50)
    x, y = near.members.select(F.col("id").alias("x"), F.col("class").alias("a")), near.members.select(F.col("id").alias("y"), F.col("class").alias("b"))
    between = near.pairs.select("a", "b").join(x, "a").join(y, "b").select("x", "y")
    within = x.join(y, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    return between.union(within).select(F.least("x", "y").alias("file_a"), F.greatest("x", "y").alias("file_b"))


def classes(files: DataFrame) -> DataFrame:
    """(file_id, class_id, n_links) at five words and 0.8: each file's class of equal shingle sets and the number of classes near it."""
    near = NearDuplicates(files)
    ends = near.pairs.select(F.col("a").alias("class")).union(near.pairs.select("b"))
    links = ends.groupBy("class").agg(F.count("*").alias("n"))
    linked = near.members.join(links, "class", "left").select("id", "class", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    # text hashes aren't negative
    texts = files.select(F.col("file_id").cast("long").alias("id"), F.col("content").isNotNull().alias("there")).where("id is not null")
    absent = texts.groupBy("id").agg(F.max("there").alias("there")).where("not there").select("id", F.lit(-1).cast("long").alias("text_key"))
    short = near.short.union(absent)
    least = short.groupBy("text_key").agg(F.min("id").alias("class"))
    rest = short.join(least, "text_key").select("id", "class", F.lit(0).cast("long").alias("n"))
    return linked.union(rest).toDF("file_id", "class_id", "n_links")
