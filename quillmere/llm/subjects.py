"""Problem 7: subject areas of each document.

Method: class-association rules mined with parallel frequent-pattern growth.

* Rules come from a bounded sample: all hand-labelled files, up to ``TRAIN_FILES``, filled up by the
  hash of the file's id.  A line of text is a transaction of its words and pairs of neighbouring words;
  its class is the subject whose gloss terms its section names, or else the only label of its file.
* Every term of at least ``MIN_SUPPORT`` lines takes part.  Terms are ordered by frequency; the lines of
  a term, with the more frequent terms in them, are its conditional base, and each base is grown by
  itself, in parallel, to bodies of any length.
* A rule is redundant if its confidence, smoothed, isn't ``GAIN`` above that of each of its parts, all
  shorter bodies in it.  The growth leaves out only what no such rule can hold (``least``, ``grow``); terms
  that tell nothing alone can tell a class together.  A fifth of the lines is held back and joins the counts
  from which a rule's evidence, its smoothed log odds, is calibrated.
* Every file is scored whole, by the evidence of the matching rules in each section.  Where two subjects
  have evidence enough, the section is divided into runs of sentences, each run one subject, so that the
  evidence less a fixed cost for each change is greatest; else its words deal with the one subject.
  Subjects with a quarter of the words stay.
* Model answers in ``category_lines`` are unreliable; their phrases, related to subjects by rules of
  the same kind, only decide about sections in which no rule matches.

Defined cases: null ids and null texts have no subject; files under 30 words have none; of a file
delivered again the text ingested last counts; equal evidence goes to the subject that comes first by
name; without labels the glosses alone train; without any gloss or label there are no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, combinations
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.markup import parse
from quillmere.plans.cut import cut

TRAIN_FILES = 3000
#: Of longer files nothing is learned; they are scored whole all the same.
TRAIN_CHARS = 40_000
MIN_SUPPORT = 6
#: Terms of the rules that a test expects of lines told by pairs of words; the growth has no such bound.
MAX_TERMS = 2
#: Groups of conditional bases.
BASES = 64
#: Confidence that a rule must have above each of its parts.
GAIN = 0.2
#: Standard deviations that its gain must be worth, as there are very many bodies.
SURE = 3.0
MIN_CONFIDENCE = 0.6
SHARE = 0.25
#: Evidence that a change of subject inside a section costs.
CHANGE = 5.0
MIN_WORDS = 30
CLASS = "class:"
#: More lines than any sample has.
NEVER = 1 << 30
#: Words of the bit sets that are made at once.
BLOCK = 1 << 19
#: Characters that are scored at once.
CHARS = 1 << 18
#: Characters that a line counts for besides its own.
LINE = 32
#: Tokens that a worker knows at a time.
TOKENS = 1 << 17

_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_SIGN = frozenset("|-–—+*/=<>&#.:")


def sections(text: str) -> list[list[str]]:
    """The lines of each section of a file: its heading first, code and formulas aside."""
    found: list[list[str]] = []
    for line in parse(text, render=True, words_only=True).text.split("\n"):
        line = line.strip()
        if line.startswith("# ") or not found:
            found.append([])
        line = line.lstrip("#- ")
        if line:
            found[-1].append(line)
    return [s for s in found if s]


def terms(line: str) -> list[str]:
    """Words and pairs of neighbouring words."""
    words = _WORD.findall(line.lower())
    return [*dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))])]


def gloss_terms(areas: list[tuple[str, str]]) -> dict[str, str]:
    """The terms that the glosses name, and their subjects."""
    found: dict[str, str] = {}
    for subject, gloss in areas:
        body = re.sub(r"^\s*pages about\s+|\s+and the like\.?\s*$", "", gloss or "", flags=re.I)
        for part in re.split(r"[,;]", body):
            if term := " ".join(_WORD.findall(part.lower())):
                found[term] = subject
    return found


def lines_of(files: DataFrame, glosses: dict[str, str]) -> DataFrame:
    """(class, held, items): the transactions of the training files."""
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, sorted(glosses, key=len, reverse=True))) + r")s?\b") if glosses else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # the terms of a whole batch would fill a worker's memory
                classes, held, items = [], [], []
                for file, label, text in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    for k, section in enumerate(sections(text)):
                        named = {glosses[m] for m in pattern.findall("\n".join(section).lower())} if pattern else set()
                        subject = next(iter(named)) if len(named) == 1 else label if not named else None
                        if subject is None:
                            continue
                        for n, line in enumerate(section):
                            classes.append(subject)
                            held.append(xxhash.xxh3_64_intdigest(f"{file} {k} {n}") % 5 == 0)
                            items.append(terms(line))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(classes, pa.string()), pa.array(held, pa.bool_()), pa.array(items, pa.list_(pa.string()))], names=["class", "held", "items"]
                )

    return files.mapInArrow(run, "class string, held boolean, items array<string>")


Rules = list[tuple[tuple[str, ...], str, float, int]]  # terms, class, confidence, support


def gains(k: np.ndarray | int, n: int, part: np.ndarray | float) -> np.ndarray | bool:
    """Whether k of n lines are worth a rule beside a part of that confidence."""
    return ((k + 1) / (n + 2) >= part + GAIN) & (k - n * part >= SURE * np.sqrt(n * part * (1 - part)))


def least(part: np.ndarray, support: float) -> np.ndarray:
    """Lines of a class that a body needs at least to be a rule, or a part of one, beside a part of that confidence: a rule gains most if
    it has no other lines."""
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(part + GAIN < 1, (2 * (part + GAIN) - 1) / (1 - part - GAIN), NEVER)
        sure = np.where(part < 1, SURE**2 * part / (1 - part), NEVER)
    return np.ceil(np.clip(np.maximum(gain, sure), MIN_CONFIDENCE * support, NEVER) - 1e-6).astype(np.int32)


def common(bits: np.ndarray, q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Lines that both have: a column of bits for each body."""
    found = np.zeros(len(q), np.int64)
    for word in bits:
        found += np.bitwise_count(word[q] & word[w])
    return found


def grow(base: int, classes: np.ndarray, owner: np.ndarray, items: np.ndarray, counts: np.ndarray, support: float) -> Iterator[tuple]:
    """Rules (body, class, lines of both, lines of the body) of the bodies of any length whose rarest term is ``base``, by their parts
    that are single or hold it.

    ``classes`` are those of the base's lines, ``items`` the more frequent terms in them, ``owner`` the line of each; ``counts`` are the
    lines of every term by class.  A body stays for a class while it has lines enough (``least``), all its parts stayed, and each of
    its terms shuts out at least the square of SURE lines of other classes: with fewer, no rule that holds the body gains."""
    here, of, sizes = np.unique(classes, return_inverse=True, return_counts=True)  # other classes can't have a rule
    often = np.bincount(items, minlength=base) >= support
    frequent = often[items]
    owner, items, terms = owner[frequent], items[frequent], np.flatnonzero(often)
    where = (np.cumsum(often) - 1)[items]
    width, wide, apart = len(here), len(terms), SURE**2 - 1e-6

    def told(k: np.ndarray, n: np.ndarray, part: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(k >= MIN_CONFIDENCE * n)
        return at[gains(k[at], n[at], part[at])]

    # bodies of two terms beside the terms alone; every row is a body and a class for which it stays, by class and last term
    k = np.bincount(of[owner] * wide + where, minlength=width * wide)
    n = np.tile(k.reshape(width, wide).sum(0), width)
    one, every = counts[base, here].repeat(wide), counts[np.ix_(terms, here)].T.ravel()
    of_one, of_every = counts[base].sum(), np.tile(counts[terms].sum(1), width)
    part = np.maximum(one / of_one, every / np.maximum(1, of_every))
    row = np.flatnonzero((k >= least(part, support)) & (np.minimum(of_one - one, of_every - every) - (n - k) >= apart))
    k, n, part = k[row], n[row], part[row]
    for j in told(k, n, part):
        yield (base, int(terms[row[j] % wide])), int(here[row[j] // wide]), int(k[j]), int(n[j])
    part = np.maximum(part, k / n)
    low = least(part, support)
    stay = np.flatnonzero(k >= low)
    if len(stay) < 2:
        return
    row, k, n, part, low = row[stay], k[stay], n[stay], part[stay], low[stay]
    # the lines of each body as bits, all of them and those of its class
    used, at = np.unique(row % wide, return_inverse=True)
    place = np.full(wide, -1)
    place[used] = np.arange(len(used))
    inside = np.flatnonzero(place[where] >= 0)
    order = np.argsort(of, kind="stable")
    nth = np.empty(len(of), np.int64)
    nth[order] = np.arange(len(of))
    flags = np.zeros((len(used), -(-len(of) // 64) * 64), bool)
    flags[place[where[inside]], nth[owner[inside]]] = True
    bits = np.packbits(flags, axis=1).view(np.uint64).T[:, at].copy()
    cls = row // wide
    own = np.zeros((len(row), -(-int(sizes.max()) // 64) * 64), bool)
    for c, to in enumerate(np.cumsum(sizes)):
        own[cls == c, : sizes[c]] = flags[at[cls == c], to - sizes[c] : to]
    own = np.packbits(own, axis=1).view(np.uint64).T.copy()
    body = (row % wide)[:, None]  # positions in terms, by rising frequency
    first = cls  # the row of the body without its last term, among the shorter ones
    parts = cls[:, None]  # the rows of the body without each of its terms after the base
    while len(body) > 1:
        last, others, length = body[:, -1], n - k, body.shape[1]
        keys = first * wide + last
        begin = np.searchsorted(first, first)
        pairs = np.arange(len(body)) - begin  # with the bodies that differ in a more frequent last term
        total = np.cumsum(pairs)
        edges = [0]
        while edges[-1] < len(body):  # in blocks of bounded memory
            done = total[edges[-1] - 1] if edges[-1] else 0
            edges.append(max(edges[-1] + 1, int(np.searchsorted(total, done + BLOCK // len(bits), "right"))))
        grown, sets = [], []
        for a, b in zip(edges[:-1], edges[1:]):
            q = np.repeat(np.arange(a, b), pairs[a:b])
            w = np.arange(len(q)) + np.repeat(begin[a:b] - (total[a:b] - pairs[a:b] - (total[a] - pairs[a])), pairs[a:b])
            hits_ = common(own, q, w)
            go = np.flatnonzero(hits_ >= np.maximum(low[q], low[w]))
            q, w, hits_ = q[go], w[go], hits_[go]
            size = common(bits, q, w)
            rest = size - hits_
            go = np.flatnonzero((size >= support) & (np.minimum(others[q], others[w]) - rest >= apart))
            q, w, hits_, size, rest = q[go], w[go], hits_[go], size[go], rest[go]
            best, known = np.maximum(part[q], part[w]), []
            for x in range(length - 1):  # without an earlier term
                key = parts[q, x] * wide + last[w]
                found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                on = np.flatnonzero((keys[found] == key) & (others[found] - rest >= apart))
                q, w, hits_, size, rest, found = q[on], w[on], hits_[on], size[on], rest[on], found[on]
                best, known = np.maximum(best[on], part[found]), [*(y[on] for y in known), found]
            for j in told(hits_, size, best):
                yield (base, *terms[body[q[j]]].tolist(), int(terms[last[w[j]]])), int(here[cls[q[j]]]), int(hits_[j]), int(size[j])
            best = np.maximum(best, hits_ / size)
            below = least(best, support)
            on = np.flatnonzero(hits_ >= below)
            known = np.column_stack([*known, w, q])[on]
            q, w = q[on], w[on]
            grown.append((np.column_stack([body[q], last[w]]), q, known, cls[q], hits_[on], size[on], best[on], below[on]))
            sets.append((bits[:, q] & bits[:, w], own[:, q] & own[:, w]))
        body, first, parts, cls, k, n, part, low = map(np.concatenate, zip(*grown))
        bits, own = (np.concatenate(x, axis=1) for x in zip(*sets))


def lines_with(transactions: DataFrame, bodies: list[tuple[str, ...]]) -> dict[tuple[str, ...], Counter]:
    """Lines of each body by class; the first term of a body is its rarest."""
    found: dict[tuple[str, ...], Counter] = defaultdict(Counter)
    if not bodies:
        return found
    shipped = transactions.sparkSession.sparkContext.broadcast(bodies)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = defaultdict(list)
        for k, body in enumerate(shipped.value):
            book[body[0]].append((k, frozenset(body[1:])))
        lines: Counter = Counter()
        for batch in batches:
            for c, terms_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                have = set(terms_)
                for x in have & book.keys():
                    for k, rest in book[x]:
                        if rest <= have:
                            lines[k, c] += 1
        body, of, n = zip(*((k, c, n) for (k, c), n in lines.items())) if lines else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(body, pa.int32()), pa.array(of, pa.string()), pa.array(n, pa.int64())], names=["body", "class", "n"])

    rows = transactions.select("class", "items").mapInArrow(run, "body int, class string, n bigint")
    for r in rows.collect():  # bounded by the sample
        found[bodies[r["body"]]][r["class"]] += r["n"]
    return found


def mine(transactions: DataFrame, support: float) -> Rules:
    """Class-association rules of (class, items) rows, without the redundant ones."""
    counts = transactions.select("class", F.explode("items").alias("item")).groupBy("item", "class").count()
    often = counts.groupBy("item").agg(F.sum("count").alias("n")).where(F.col("n") >= support)
    known: dict[str, Counter] = defaultdict(Counter)
    for r in counts.join(often, "item").select("item", "class", "count").collect():  # bounded by the sample
        known[r["item"]][r["class"]] += r["count"]
    classes = sorted({c for x in known.values() for c in x})
    rules: dict[tuple[tuple[str, ...], str], tuple[float, int]] = {}
    for item, x in known.items():
        n = sum(x.values())
        for c, k in x.items():
            if k >= MIN_CONFIDENCE * n:
                rules[(item,), c] = (k / n, n)
    names = sorted(known, key=lambda i: (-sum(known[i].values()), i))
    lines = np.array([[known[i][c] for c in classes] for i in names], np.int64).reshape(-1, max(1, len(classes)))
    can = (lines >= least(lines / np.maximum(1, lines.sum(1, keepdims=True)), support)).any(1)  # the others are in no longer rule
    names, lines = [i for i, x in zip(names, can) if x], lines[can]
    shipped = transactions.sparkSession.sparkContext.broadcast(({i: k for k, i in enumerate(names)}, classes, lines))  # bounded by the sample

    def bases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, order, _ = shipped.value
        number = {c: k for k, c in enumerate(order)}
        for batch in batches:
            item, of, before = [], [], []
            for c, terms_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if c not in number:
                    continue
                ids = sorted(rank[t] for t in set(terms_) if t in rank)
                for k in range(1, len(ids)):
                    item.append(ids[k])
                    of.append(number[c])
                    before.append(ids[:k])
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(of, pa.int32()), pa.array(before, pa.list_(pa.int32()))], names=["item", "class", "before"])

    def grown(table: pa.Table) -> pa.Table:
        lines = shipped.value[2]
        lists = table.column("before").combine_chunks()
        of, item = table.column("class").to_numpy().astype(np.int64), table.column("item").to_numpy()
        starts, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype(np.int64)
        order = np.argsort(item, kind="stable")
        edges = np.concatenate([[0], np.flatnonzero(np.diff(item[order])) + 1, [len(item)]])
        out = []
        for a, b in zip(edges[:-1], edges[1:]):
            at, base = order[a:b], int(item[order[a]])
            sizes = starts[at + 1] - starts[at]
            inside = np.repeat(starts[at] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            out += grow(base, of[at], np.repeat(np.arange(len(at)), sizes), values[inside], lines, support)
        columns = list(zip(*out)) if out else [[]] * 4
        kinds = (pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(v, t) for v, t in zip(columns, kinds)], names=["body", "class", "k", "n"])

    # terms by rank, so that every group of bases has frequent and rare ones; of a bounded sample
    rows = transactions.select("class", "items").mapInArrow(bases, "item int, class int, before array<int>")
    more = rows.groupBy(F.pmod("item", F.lit(BASES)).alias("base")).applyInArrow(grown, "body array<int>, class int, k bigint, n bigint").collect()  # bounded by the sample
    # a base knows its own lines only: the parts without it are counted over all lines
    bodies = [tuple(names[i] for i in r["body"]) for r in more]
    unknown = {x for body in bodies for size in range(2, len(body)) for x in combinations(body[1:], size)}
    counted = lines_with(transactions, sorted(unknown, key=lambda x: (len(x), x)))
    for body, r in zip(bodies, more):
        subject = classes[r["class"]]
        parts = (counted[x] for size in range(2, len(body)) for x in combinations(body[1:], size))
        if all(gains(r["k"], r["n"], x[subject] / sum(x.values())) for x in parts):
            rules[tuple(sorted(body)), subject] = (r["k"] / r["n"], r["n"])
    return [(body, subject, *v) for (body, subject), v in sorted(rules.items())]


def blocks(lines: list[str]) -> Iterator[tuple[int, int]]:
    """The ends of runs of lines of bounded size."""
    at = size = 0
    for k, line in enumerate(lines, 1):
        size += len(line) + LINE
        if size >= CHARS or k == len(lines):
            yield at, k
            at, size = k, 0


class Tokens(dict):
    """By token, between blanks: the number of its word; -1 of words that no rule has, -2 of none, -3 of a lone sign; else, from -4 down,
    the place of its words in ``several``."""

    def __init__(self, number: dict[str, int]):
        self.number, self.several = number, []

    def __missing__(self, token: str) -> int:
        ids = [self.number.get(w, -1) for w in _WORD.findall(token.lower())]
        if not ids:
            code = -3 if token in _SIGN else -2
        elif len(ids) == 1 or max(ids) < 0:
            code = ids[0]
        else:
            code = -4 - len(self.several)
            self.several.append(ids)
        if len(self) < TOKENS:
            self[token] = code
        return code


class RuleBook:
    """Rules with their evidence, for many lines at once.

    Terms are numbers, words before pairs of neighbouring words.  Evidence is kept to 2**-32, so that its sums are the same in any order.
    A body has one subject at most, as MIN_CONFIDENCE is more than a half."""

    def __init__(self, rules: list[tuple[tuple[str, ...], str, float]]):
        self.names = sorted({subject for _, subject, _ in rules}) or [""]
        every = {x for body, _, _ in rules for x in body}
        number = {w: k for k, w in enumerate(sorted({w for x in every for w in x.split(" ")}))}
        self.tokens, self.wide = Tokens(dict(number)), len(number)
        near = sorted((number[a] * self.wide + number[b], x) for x in every if " " in x for a, b in [x.split(" ")])
        number |= {x: self.wide + k for k, (_, x) in enumerate(near)}
        self.near, self.terms = np.array([k for k, _ in near], np.int64), len(number)
        self.begins, self.ends, self.used = np.zeros(self.wide, bool), np.zeros(self.wide, bool), np.zeros(self.terms, bool)
        self.begins[self.near // max(1, self.wide)] = self.ends[self.near % max(1, self.wide)] = True
        self.used[[number[x] for x in every]] = True
        of = {s: k for k, s in enumerate(self.names)}
        self.subject, self.value = np.full(self.terms, -1), np.zeros(self.terms)  # of the rules of one term
        uses = Counter(x for body, _, _ in rules if len(body) > 1 for x in body)
        more = []  # by the rarest part
        for body, subject, evidence in rules:
            first, *others = (number[x] for x in sorted(body, key=lambda x: (uses[x], x)))
            value = round(evidence * 2**32) / 2**32
            if others:
                more.append((first, others, of[subject], value))
            else:
                self.subject[first], self.value[first] = of[subject], value
        more.sort()
        self.begin = np.searchsorted([x for x, *_ in more], np.arange(self.terms + 1))
        self.others = np.full((len(more), max((len(x) for _, x, *_ in more), default=0)), -1)
        for k, (_, others, _, _) in enumerate(more):
            self.others[k, : len(others)] = others
        self.more_subject, self.more_value = np.array([x[2] for x in more], np.int64), np.array([x[3] for x in more], float)

    def read(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word as its number, -1 if no rule has it, and its line; the tokens of each line that aren't lone signs."""
        if len(self.tokens) >= TOKENS or len(self.tokens.several) >= TOKENS:
            self.tokens = Tokens(self.tokens.number)
        split = [line.split() for line in lines]
        sizes = np.array([*map(len, split)], np.int64)
        ids = np.fromiter(map(self.tokens.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        line = np.repeat(np.arange(len(lines)), sizes)
        sizes -= np.bincount(line[ids == -3], minlength=len(lines))
        word = (ids >= -1) | (ids <= -4)
        ids, line = ids[word], line[word]
        if len(at := np.flatnonzero(ids <= -4)):
            several = [self.tokens.several[-4 - k] for k in ids[at].tolist()]
            times = np.ones(len(ids), np.int64)
            times[at] = [*map(len, several)]
            ids, line = np.repeat(ids, times), np.repeat(line, times)
            ids[ids <= -4] = [*chain.from_iterable(several)]
        return ids, line, sizes

    def evidence(self, lines: list[str], owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Words by owner of the lines, and evidence by owner and subject: a pair of neighbouring words with a rule of its own stands for
        its words in a line."""
        ids, line, words = self.read(lines)
        at = np.flatnonzero(ids >= 0)

        def place(among: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Where sorted numbers have the keys, and whether they do."""
            if not len(among):
                return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
            k = np.minimum(np.searchsorted(among, keys), len(among) - 1)
            return k, among[k] == keys

        a, b = at[:-1], at[1:]
        near = a[(b - a == 1) & (line[a] == line[b]) & self.begins[ids[a]] & self.ends[ids[b]]]
        pair, on = place(self.near, ids[near] * self.wide + ids[near + 1])
        near, pair = near[on], self.wide + pair[on]
        at = at[self.used[ids[at]]]
        have = np.sort(np.concatenate([line[at] * self.terms + ids[at], line[near] * self.terms + pair]))
        have = have[np.append(True, have[1:] != have[:-1])[: len(have)]]
        own = self.subject[term := have % max(1, self.terms)] >= 0
        alone = near[self.subject[pair] >= 0]
        for word in (ids[alone], ids[alone + 1]):
            k, on = place(have, line[alone] * self.terms + word)
            own[k[on]] = False
        line = have - term
        to = owner[line // max(1, self.terms)] * len(self.names)
        found = np.zeros(size * len(self.names))
        found += np.bincount(to[own] + self.subject[term[own]], self.value[term[own]], len(found))
        has = np.flatnonzero(many := self.begin[term + 1] - self.begin[term])
        many, total = many[has], np.cumsum(many[has])
        a = done = 0
        while a < len(has):  # in blocks of bounded memory
            b = max(a + 1, int(np.searchsorted(total, done + BLOCK, "right")))
            i = np.repeat(has[a:b], many[a:b])
            rule = np.arange(len(i)) + np.repeat(self.begin[term[has[a:b]]] - (total[a:b] - many[a:b] - done), many[a:b])
            for n in range(self.others.shape[1]):
                other = self.others[rule, n]
                on = (other < 0) | place(have, line[i] + other)[1]
                i, rule = i[on], rule[on]
            found += np.bincount(to[i] + self.more_subject[rule], self.more_value[rule], len(found))
            a, done = b, int(total[b - 1])
        return np.bincount(owner, words, size).astype(np.int64), found.reshape(size, -1)


def train(files: DataFrame, labels: DataFrame, areas: DataFrame) -> list[tuple[tuple[str, ...], str, float]]:
    known = [(r["subject"], r["gloss"]) for r in areas.select("subject", "gloss").where("subject is not null").distinct().collect()]  # a closed list
    glosses, names = gloss_terms(known), {s for s, _ in known}
    single = labels.where("file_id is not null and subject is not null").groupBy("file_id").agg(F.min("subject").alias("label"), F.count_distinct("subject").alias("n"))
    single = single.select("file_id", F.when(F.col("n") == 1, F.col("label")).alias("label"), F.lit(0).alias("turn"))
    texts = files.select(F.col("file_id").cast("long"), F.col("content").cast("string").alias("text"))
    texts = texts.where((F.length("text") <= TRAIN_CHARS) & F.col("file_id").isNotNull())
    picked = (
        texts.select("file_id")
        .distinct()
        .join(single, "file_id", "left")
        .orderBy(F.coalesce("turn", F.lit(1)), F.xxhash64("file_id"), "file_id")
        .limit(TRAIN_FILES)
        .select("file_id", "label")
    )
    chosen = cut(picked, "picked")  # at most TRAIN_FILES ids
    sample = texts.join(F.broadcast(chosen), "file_id").select("file_id", "label", "text").dropDuplicates(["file_id"])
    # copies and reworked copies repeat their lines, which would make whole lines frequent
    lines = cut(lines_of(sample, glosses).dropDuplicates(["class", "items"]), "lines")
    lines = lines.where(F.col("class").isin(*names)) if names else lines.limit(0)
    rows = lines.where(F.size("items") > 0)
    rules = mine(rows.where("not held"), MIN_SUPPORT)
    book = defaultdict(list)
    for k, (body, _, _, _) in enumerate(rules):
        book[body[0]].append(k)
    hits, right = Counter(), Counter()
    for r in rows.where("held").select("class", "items").collect():  # a fifth of the sample
        have = set(r["items"])
        for x in have:
            for k in book.get(x, ()):
                if have.issuperset(rules[k][0]):
                    hits[k] += 1
                    right[k] += rules[k][1] == r["class"]
    found = []
    for k, (body, subject, confidence, n) in enumerate(rules):
        good, all_ = confidence * n + right[k], n + hits[k]
        evidence = log((good + 0.5) / (all_ - good + 0.5))
        if evidence > 0:
            found.append((body, subject, evidence))
    return found


def runs(evidence: list[dict[str, float]]) -> list[str]:
    """The subject of each unit, with the greatest evidence less CHANGE for each change."""
    names = sorted({s for e in evidence for s in e})
    if not names:
        return []
    best = {s: 0.0 for s in names}
    back: list[dict[str, str]] = []
    for k, e in enumerate(evidence):
        top = min(names, key=lambda s: (-best[s], s))
        came, now = {}, {}
        for s in names:
            stay, move = best[s], best[top] - (CHANGE if k else 0.0)
            came[s] = s if stay >= move else top
            now[s] = max(stay, move) + e.get(s, 0.0)
        back.append(came)
        best = now
    found = [min(names, key=lambda s: (-best[s], s))]
    for came in reversed(back[1:]):
        found.append(came[found[-1]])
    return found[::-1]


def shares(parts: list[list[str]], book: RuleBook) -> list[tuple[dict[str, int], int]]:
    """Words by subject, and all words, of each section."""
    lines = [line for section in parts for line in section]
    owner = np.repeat(np.arange(len(parts)), [len(section) for section in parts])
    words, total = np.zeros(len(parts), np.int64), np.zeros((len(parts), len(book.names)))
    for a, b in blocks(lines):
        own = slice(owner[a], owner[b - 1] + 1)
        n, evidence = book.evidence(lines[a:b], owner[a:b] - owner[a], own.stop - own.start)
        words[own] += n
        total[own] += evidence
    order = np.argsort(-total, axis=1, kind="stable")[:, :2]  # of equal ones the first by name
    best = np.take_along_axis(total, order, 1)
    found = [({book.names[s]: n} if v > 0 else {}, n) for s, v, n in zip(order[:, 0].tolist(), best[:, 0].tolist(), words.tolist())]
    several = np.flatnonzero(best[:, 1:].sum(1) > CHANGE).tolist()  # else no run of another subject could pay for its change
    units = [[u for line in parts[k] for u in _SENTENCE.split(line)] for k in several]
    every, sizes, told = [*chain.from_iterable(units)], [], []
    for a, b in blocks(every):
        n, evidence = book.evidence(every[a:b], np.arange(b - a), b - a)
        sizes += n.tolist()
        told += [{book.names[s]: v for s, v in enumerate(e) if v > 0} for e in evidence.tolist()]
    at = 0
    for k, own in zip(several, units):
        deals: Counter = Counter()
        for n, subject in zip(sizes[at : at + len(own)], runs(told[at : at + len(own)])):
            deals[subject] += n
        at += len(own)
        if deals:  # else only rules whose terms stand in different sentences
            found[k] = deals, found[k][1]
    return found


SCORED = "file_id bigint, ingested bigint, text_key bigint, words bigint, open bigint, subjects map<string, bigint>"


def score(files: DataFrame, rules: list[tuple[tuple[str, ...], str, float]]) -> DataFrame:
    """(file_id, words, open, subjects): words of each file, of its sections without evidence, and by subject."""
    shipped = files.sparkSession.sparkContext.broadcast(rules)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = RuleBook(shipped.value)
        kinds = (pa.int64(),) * 5 + (pa.map_(pa.string(), pa.int64()),)
        for batch in batches:
            files_, waiting, size = [], [], 0

            def settle(waiting: list[tuple[list, list[str]]]) -> None:
                for (row, _), (held, n) in zip(waiting, shares([section for _, section in waiting], book)):
                    row[3] += n
                    if not held:
                        row[4] += n
                    row[5].update(held)

            for file, when, text in zip(*(c.to_pylist() for c in batch.columns)):
                key = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1
                files_.append([file, when, key, 0, 0, Counter()])
                for section in sections(text):
                    waiting.append((files_[-1], section))
                    size += sum(map(len, section)) + LINE * len(section)
                    if size >= CHARS:
                        settle(waiting)
                        waiting, size = [], 0
            settle(waiting)
            out = [(*row, sorted(subjects.items())) for *row, subjects in files_]
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["file_id", "ingested", "text_key", "words", "open", "subjects"]
            )

    when = F.coalesce(F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(0))
    rows = files.select(F.col("file_id").cast("long"), when.cast("long"), F.col("content").cast("string").alias("text"))
    scored = rows.where("file_id is not null and text is not null").mapInArrow(run, SCORED)
    last = scored.groupBy("file_id").agg(F.max_by(F.struct("words", "open", "subjects"), F.struct("ingested", "text_key")).alias("x"))
    return last.select("file_id", "x.words", "x.open", "x.subjects")


def phrases(categories: DataFrame) -> DataFrame:
    """(file_id, phrase): the distinct phrases of the model answers."""
    body = F.regexp_replace(F.lower("extracted_categories"), r"categor(?:y|ies)\s*:", " ")
    parts = F.split(F.regexp_replace(body, r"(?m)^\s*[-*]\s+|\d+\.\s", ";"), r"[,;/\n|]|\betc\.?")
    rows = categories.where("file_id is not null").select(F.col("file_id").cast("long"), F.explode(parts).alias("p"))
    rows = rows.select("file_id", F.trim(F.regexp_replace("p", r"[^\p{L}\p{N} -]+", "")).alias("phrase"))
    return rows.where(~F.col("phrase").isin("", "none", "no categories found")).distinct()


def found(files: DataFrame, categories: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(file_id, subject) of the subjects with which at least a quarter of a file's words deal."""
    scored = cut(score(files, train(files, labels, areas)), "scored")
    shares = scored.where(F.col("words") >= MIN_WORDS).select("file_id", "words", "open", F.explode("subjects").alias("subject", "n"))
    # what phrases of the model answers go with, by the subjects found in the text
    said = phrases(categories)
    main = shares.where(F.col("n") >= 0.5 * F.col("words")).select("file_id", "subject")
    pairs = said.join(main, "file_id").groupBy("phrase", "subject").count()
    best = pairs.groupBy("phrase").agg(F.sum("count").alias("n"), F.max(F.struct("count", "subject")).alias("x"))
    sure = best.where((F.col("n") >= MIN_SUPPORT) & (F.col("x.count") >= MIN_CONFIDENCE * F.col("n"))).select("phrase", F.col("x.subject").alias("subject"))
    unclear = scored.where((F.col("open") > 0) & (F.col("words") >= MIN_WORDS)).select("file_id", "words", "open")
    hints = said.join(unclear, "file_id").join(sure, "phrase").groupBy("file_id", "words", "open").agg(F.collect_set("subject").alias("s"))
    extra = hints.where(F.size("s") == 1).select("file_id", "words", F.col("s")[0].alias("subject"), F.col("open").alias("n"))
    every = shares.select("file_id", "words", "subject", "n").union(extra).groupBy("file_id", "words", "subject").agg(F.sum("n").alias("n"))
    return every.where(F.col("n") >= SHARE * F.col("words")).select("file_id", "subject")
