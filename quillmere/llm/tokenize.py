"""Problem 8: encoding of the whole corpus with a public byte-pair vocabulary.

Method: the merges are compiled, one gadget after the other, into a deterministic automaton whose
arcs carry tokens; a sequence of arcs is a path exactly if it is the encoding of its bytes.  The
automaton starts as one state with an arc for each byte.  The merge of (u, v) into w

* splits the state after u and takes its arc v away,
* gives w to each state from which u and then v could be taken,
* and lets w end in the state in which v ended before the split.

Written out, the arcs of 50,000 states would fill gigabytes; so a state keeps only what its gadgets
changed, and whether the state after ``a`` has an arc ``b`` is found by walking back through the
gadgets that made a and b, then kept in a table.  A word is read from left to right: the tokens that
may end at a position are looked up in a table of suffixes, and the one arc that the state at its
start has becomes the state of that position.  Every position is visited once, at most
``longest token`` arcs are tried at each, and no pair is ever merged at run time.  Decoding emits
the arcs' labels.

Words are pre-split by the vocabulary's public pattern; a worker keeps the ids of the words it has
met in a bounded table.  No shuffle is needed and no row is dropped.

Defined cases: null and empty text have the empty list; special tokens' strings are ordinary text;
other columns aren't read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The public pattern of the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED_WORDS = 300_000


def printable_bytes() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary file means."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Known arcs that a worker keeps.
KEPT_ARCS = 1_000_000


class Automaton:
    """States after tokens, in the compact form that the gadgets leave behind."""

    def __init__(self, vocabulary: bytes):
        model = json.loads(vocabulary)["model"]
        means = printable_bytes()
        to_bytes = lambda piece: bytes(means[c] for c in piece if c in means)
        special = {piece for piece in model["vocab"] if any(c not in means for c in piece)}
        pieces = {piece: i for piece, i in model["vocab"].items() if piece not in special}
        self.label: dict[int, bytes] = {}
        self.token: dict[bytes, int] = {}
        size = max(model["vocab"].values()) + 1
        self.left, self.right, self.born = [0] * size, [0] * size, [-1] * size
        self.removed: dict[int, int] = {}  # u * size + v -> the gadget that took arc v from the state after u
        self.size = size
        for b in means:
            self._name(pieces[b], to_bytes(b))
        for step, merge in enumerate(model["merges"]):
            u, v = merge.split(" ") if isinstance(merge, str) else merge
            self._gadget(step, pieces[u], pieces[v], pieces[u + v])
        self.tails = {text[k:] for text in self.token for k in range(len(text))}
        self.arcs: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {"": []}

    def _name(self, token: int, text: bytes) -> None:
        self.label[token] = text
        self.token[text] = token

    def _gadget(self, step: int, u: int, v: int, w: int) -> None:
        self.removed[u * self.size + v] = step
        self.left[w], self.right[w], self.born[w] = u, v, step
        self._name(w, self.label[u] + self.label[v])

    def arc(self, a: int, b: int) -> bool:
        """Whether the state after a has an arc b."""
        key = a * self.size + b
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= KEPT_ARCS:
                self.arcs.clear()
            known = self.arcs[key] = self._walk(a, b)
        return known

    def _walk(self, a: int, b: int) -> bool:
        born, until = self.born, len(self.born)
        while True:
            if self.removed.get(a * self.size + b, until + 1) <= until:
                return False
            x, y = born[a], born[b]
            if x < 0 and y < 0:
                return True
            if x > y:  # the state after a is the one after its right part as it stood before the gadget
                a, until = self.right[a], x - 1
            elif x < y:  # arc b was laid where its left part had an arc once the gadget had split its state
                b, until = self.left[b], y
            else:
                a, b, until = self.right[a], self.left[b], x - 1

    def word(self, text: bytes) -> list[int]:
        """The path that spells ``text``."""
        state: list[int] = [-1]
        for end in range(1, len(text) + 1):
            fits, start = [], end - 1
            while start >= 0 and (piece := text[start:end]) in self.tails:
                if (t := self.token.get(piece)) is not None:
                    fits.append((start, t))
                start -= 1
            state.append(next(t for s, t in reversed(fits) if s == 0 or self.arc(state[s], t)))
        path, end = [], len(text)
        while end:
            path.append(state[end])
            end -= len(self.label[state[end]])
        return path[::-1]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        words = self.words
        for piece in SPLIT(text):
            known = words.get(piece)
            if known is None:
                known = self.word(piece.encode("utf-8", "surrogatepass"))
                if len(words) >= CACHED_WORDS:
                    words.clear()
                if len(piece) <= 64:
                    words[piece] = known
            ids += known
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.label[i] for i in ids).decode("utf-8", "replace")


SPLIT = regex.compile(PATTERN).findall
_MADE: dict[int, Automaton] = {}


def automaton(vocabulary: bytes) -> Automaton:
    """One automaton a worker process."""
    key = hash(vocabulary)
    if key not in _MADE:
        _MADE[key] = Automaton(vocabulary)
    return _MADE[key]


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row."""
    shipped = documents.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())  # a file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(shipped.value)
        for batch in batches:
            lists = [a.encode(t) if t else [] for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(ends[-1]))
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")


def round_trip(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_ids, same): whether the decoded ids are the text again."""
    shipped = documents.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(shipped.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [a.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([a.decode(x) == t for x, t in zip(ids, texts)])],
                names=["doc_id", "n_ids", "same"],
            )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, n_ids bigint, same boolean"
    )
