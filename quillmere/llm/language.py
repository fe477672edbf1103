"""Problem 10: missing or wrong document language labels.

Method: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient
descent in numpy, with calibrated rejection.

The model is fitted on a bounded sample of labelled rows (``PER_LANGUAGE`` documents a language,
each of at most ``TRAIN_CHARS`` characters, chosen by the hash of their id, so that it doesn't
depend on the partitioning) and on a few sentences of our own for each language.  Labels are
unreliable, so a briefly trained model first drops the paragraphs that it contradicts.  A held-out fifth sets the temperature and the probability below which a segment gets no
language.  As the model is linear in the average, each word adds a fixed vector of eight numbers; a
worker keeps these vectors in a bounded table, so the corpus costs one look-up a word.

All documents are classified, whole, in one pass without a shuffle.

Defined cases: null, empty and blank texts and texts of data only have no segment; a text under 60
characters is never a case; equal sums of running text go to the language that comes first in
``LANGUAGES``; a table without usable labels is served by the built-in sentences.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl", "pl")
#: Spellings of language labels, besides region suffixes (fixed values of ISO 639 and plain names).
SPELLINGS = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol"),
    "it": ("it", "ita", "italian", "italiano"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
    "pl": ("pl", "pol", "polish", "polski"),
}
BUILT_IN = {
    "en": "the key was not found and we have to ask them again before they leave. it is not clear whether this will work for all of you. "
    "there are more than ten of these in the house, which is why she would like to see it. when he came back from work nobody was there. "
    "please tell us what you want to do with the old one, as soon as you can.",
    "de": "der schlüssel wurde nicht gefunden und wir müssen sie noch einmal fragen, bevor sie gehen. es ist nicht klar, ob das für alle geht. "
    "im haus gibt es mehr als zehn davon, weshalb sie es gern sehen würde. als er von der arbeit zurückkam, war niemand da. "
    "bitte sagen sie uns, was mit dem alten geschehen soll, sobald das möglich ist.",
    "fr": "la clé n'a pas été trouvée et nous devons leur demander encore avant qu'ils partent. on ne sait pas si cela ira pour tous. "
    "il y en a plus de dix dans la maison, c'est pourquoi elle voudrait la voir. quand il est revenu du travail, personne n'était là. "
    "dites-nous ce que vous voulez faire de l'ancien dès que vous pouvez.",
    "es": "la llave no se encontró y tenemos que preguntarles otra vez antes de que se vayan. no está claro si esto sirve para todos. "
    "hay más de diez de ellos en la casa, por lo que a ella le gustaría verla. cuando él volvió del trabajo no había nadie. "
    "díganos qué quiere hacer con el viejo en cuanto pueda.",
    "it": "la chiave non è stata trovata e dobbiamo chiedere loro ancora una volta prima che vadano via. non è chiaro se questo vada bene per tutti. "
    "ce ne sono più di dieci nella casa, perciò lei vorrebbe vederla. quando lui è tornato dal lavoro non c'era nessuno. "
    "ci dica che cosa vuole fare di quello vecchio appena può.",
    "pt": "a chave não foi encontrada e temos de lhes perguntar outra vez antes que saiam. não está claro se isto serve para todos. "
    "há mais de dez deles na casa, e por isso ela gostaria de a ver. quando ele voltou do trabalho não havia ninguém. "
    "diga-nos o que quer fazer com o velho assim que puder.",
    "nl": "de sleutel werd niet gevonden en we moeten het hun nog een keer vragen voordat zij weggaan. het is niet duidelijk of dit voor iedereen werkt. "
    "er zijn er meer dan tien van in het huis, daarom wil zij het graag zien. toen hij van het werk terugkwam was er niemand. "
    "zeg ons alstublieft wat u met de oude wilt doen zodra dat kan.",
    "pl": "klucz nie został znaleziony i musimy ich jeszcze raz zapytać, zanim wyjdą. nie jest jasne, czy to nadaje się dla wszystkich. "
    "w domu jest ich więcej niż dziesięć, dlatego ona chciałaby go zobaczyć. kiedy on wrócił z pracy, nikogo nie było. "
    "proszę nam powiedzieć, co zrobić ze starym, gdy tylko to możliwe.",
}
PER_LANGUAGE = 300
TRAIN_CHARS = 20_000
MIN_CHARS = 60
MIN_WORDS = 5
MIN_LETTERS = 20
LEAST_STEPS, FIRST_STEPS = 700, 400
BUCKETS = 1 << 16
DIMENSIONS = 16
CACHED_WORDS = 200_000

_TOKEN = re.compile(r"\S+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_EDGES = " \t\"'“”„«»‘’()[]{}<>.,;:!?…*_|~`#>-–—¿¡"
_QUOTED = re.compile(r"<\|[^|\n]*\|>|\"[^\"\n]{0,200}\"|“[^”\n]{0,200}”|`[^`\n]*`|\]\([^)\n]*\)|<[a-zA-Z/!][^<>\n]*>|\$[^$\n]+\$|https?://\S+")
_FENCE = re.compile(r"\s*(```|~~~)")


def label_of(lang: Column) -> Column:
    """The language that a label names, or null."""
    head = F.regexp_extract(F.lower(F.trim(lang)), r"^([^\W\d_]+)", 1)
    found = F.lit(None).cast("string")
    for code, names in SPELLINGS.items():
        found = F.when(head.isin(*names), F.lit(code)).otherwise(found)
    return found


def running_words(line: str) -> list[str]:
    """The words of a line that belong to running text: data, names in capitals, code and quotes aside."""
    words = []
    for token in _TOKEN.findall(_QUOTED.sub(" ", html.unescape(line) if "&" in line else line)):
        token = token.strip(_EDGES)
        if not token or (len(token) > 1 and token.isupper()):
            continue
        parts = token.split("-")
        if all(_WORD.fullmatch(p) for p in parts):
            words += [p.lower() for p in parts]
    return words


def paragraphs(text: str) -> list[tuple[int, list[str], int]]:
    """(number, running words, their characters) of each paragraph."""
    found: list[tuple[int, list[str], int]] = []
    number, words, inside, fence = 0, None, False, ""
    for line in text.split("\n"):
        if not line.strip():
            if words is not None:
                found.append((number, words, sum(map(len, words))))
                words = None
            continue
        if words is None:
            number, words = number + 1, []
        mark = _FENCE.match(line)
        if mark:
            if inside and mark[1] == fence:
                inside = False
            elif not inside:
                inside, fence = True, mark[1]
            continue
        if not inside:
            words += running_words(line)
    if words is not None:
        found.append((number, words, sum(map(len, words))))
    return found


def enough(words: list[str]) -> bool:
    """Whether the words are running text that can have a language."""
    long = [w for w in words if len(w) > 1]
    return len(long) >= MIN_WORDS and sum(map(len, long)) >= MIN_LETTERS


def subwords(word: str) -> list[int]:
    """Buckets of the word and of its runs of two to four characters."""
    w = f"<{word}>"
    grams = {w} | {w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)}
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for g in sorted(grams)]


@dataclass
class Model:
    scores: np.ndarray  # BUCKETS x languages: the embeddings times the softmax weights
    bias: np.ndarray
    temperature: float
    least: float

    def __post_init__(self) -> None:
        self.index: dict[str, int] = {}
        self.vectors = np.zeros((CACHED_WORDS, len(LANGUAGES)))
        self.sizes = np.zeros(CACHED_WORDS, np.int64)

    def _add(self, w: str) -> int:
        """The place of a new word in the table."""
        k = len(self.index)
        ids = subwords(w)
        self.vectors[k] = self.scores[ids].sum(0, dtype=np.float64)
        self.sizes[k] = len(ids)
        self.index[w] = k
        return k

    def classify(self, words: list[str]) -> tuple[int, float]:
        """Language and probability."""
        total, n = np.zeros(len(LANGUAGES)), 0
        for at in range(0, len(words), CACHED_WORDS // 2):
            part = words[at : at + CACHED_WORDS // 2]
            if len(self.index) + len(part) > CACHED_WORDS:
                self.index.clear()
            get, add = self.index.get, self._add
            rows = [k if (k := get(w)) is not None else add(w) for w in part]
            total += self.vectors[rows].sum(0)
            n += int(self.sizes[rows].sum())
        z = (total / max(n, 1) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return best, float(p[best])


def _descend(bags: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator, epochs: int, steps: int = LEAST_STEPS, rate: float = 0.7):
    """Stochastic gradient descent with per-bucket step sizes."""
    emb = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIMENSIONS, len(LANGUAGES))).astype(np.float32)
    bias, seen_e, seen_o = np.zeros(len(LANGUAGES), np.float32), np.full((BUCKETS, 1), 1e-2, np.float32), np.full_like(out, 1e-2)
    for _ in range(max(epochs, -(-steps * 32 // max(1, len(bags))))):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 32):
            pick = order[at : at + 32]
            ids = np.concatenate([bags[i] for i in pick])
            sizes = np.array([len(bags[i]) for i in pick])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(emb[ids], starts, axis=0) / sizes[:, None]
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            p /= len(pick)
            back = (p @ out.T) / sizes[:, None]
            grad = mean.T @ p
            seen_o += grad**2
            out -= rate * grad / np.sqrt(seen_o)
            bias -= 0.1 * p.sum(0)
            order_ = np.argsort(ids.astype(np.uint16), kind="stable")  # there are 2^16 buckets
            sorted_ = ids[order_]
            first = np.concatenate([[0], np.flatnonzero(np.diff(sorted_)) + 1])
            unique = sorted_[first]
            push = np.add.reduceat(back.astype(np.float32)[np.repeat(np.arange(len(pick)), sizes)[order_]], first, axis=0)
            seen_e[unique] += (push**2).mean(1, keepdims=True)
            emb[unique] -= rate * push / np.sqrt(seen_e[unique])
    return emb @ out, bias


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model from (language, text) rows with unreliable languages."""
    rng = np.random.default_rng(seed)
    texts: list[tuple[int, list[str]]] = []
    labels: dict[str, set[str]] = {}
    for lang, text in rows:
        labels.setdefault(text, set()).add(lang)
    # copies count once, and not at all if their labels contradict each other
    for lang, text in ((next(iter(x)), t) for t, x in labels.items() if len(x) == 1):
        texts += [(LANGUAGES.index(lang), w) for _, w, _ in paragraphs(text) if len(w) >= 6]
    own = [(k, running_words(s)) for k, lang in enumerate(LANGUAGES) for s in BUILT_IN[lang].split(". ")]
    table: dict[str, list[int]] = {}

    def bag(ws: list[str]) -> np.ndarray:
        for w in ws:
            if w not in table:
                table[w] = subwords(w)
        return np.array([i for w in ws for i in table[w]], np.int64)

    own_bags, own_y = [bag(w) for _, w in own] * 3, np.array([k for k, _ in own] * 3)
    bags, y = [bag(w) for _, w in texts], np.array([k for k, _ in texts], np.int64)
    held = rng.random(len(bags)) < 0.2

    def train(keep: np.ndarray, epochs: int, steps: int = LEAST_STEPS):
        chosen = [b for b, k in zip(bags, keep) if k]
        return _descend(own_bags + chosen, np.concatenate([own_y, y[keep]]), rng, epochs, steps)

    def raw(scores: np.ndarray, bias: np.ndarray, which: np.ndarray) -> np.ndarray:
        return np.array([scores[bags[i]].mean(0) + bias for i in np.flatnonzero(which)]).reshape(-1, len(LANGUAGES))

    # a model that has seen the sample only a few times hasn't learned single wrong labels
    scores, bias = train(np.ones(len(bags), bool), 2, FIRST_STEPS)
    agree = raw(scores, bias, np.ones(len(bags), bool)).argmax(1) == y
    scores, bias = train(~held & agree, 5)
    temperature, least = 0.35, 0.5  # where too little is held out to calibrate
    check = held & agree
    if check.sum() >= 50:
        z, t = raw(scores, bias, check), y[check]

        def loss(temp: float) -> float:
            s = z / temp
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(t)), t]).mean())

        temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
        p = np.exp((z - z.max(1, keepdims=True)) / temperature)
        p /= p.sum(1, keepdims=True)
        top, right = p.max(1), p.argmax(1) == t
        for least in np.arange(0.4, 0.96, 0.05):
            if right[top >= least].mean() >= 0.998:
                break
    return Model(scores.astype(np.float32), bias, temperature, float(least))


def sample(documents: DataFrame) -> list[tuple[str, str]]:
    """At most PER_LANGUAGE labelled texts a language."""
    rows = documents.select(F.col("doc_id"), label_of(F.col("lang")).alias("lang"), "text").where(
        F.col("lang").isNotNull() & F.length("text").between(MIN_CHARS, TRAIN_CHARS)
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= PER_LANGUAGE)
    return [(r["lang"], r["text"]) for r in sorted(picked.collect(), key=lambda r: (r["lang"], r["n"]))]


SEGMENTS = "doc_id bigint, seg_no bigint, lang string, confidence double, label string, chars bigint"


def parts_of(m: Model, text: str) -> tuple[int, float, int, list[tuple[int, int, float, int]]] | None:
    """(language, confidence, characters, paragraphs) of a text, with (number, language, confidence, characters) of each paragraph."""
    parts, sums = [], np.zeros(len(LANGUAGES))
    every: list[str] = []
    for number, words, chars in paragraphs(text):
        every += words
        if enough(words):
            k, p = m.classify(words)
            if p >= m.least:
                sums[k] += chars
                parts.append((number, k, p, chars))
    if parts:
        best = int(sums.argmax())
        return best, sum(p * c for _, k, p, c in parts if k == best) / sums[best], int(sums.sum()), parts
    if enough(every):  # only very short paragraphs
        k, p = m.classify(every)
        if p >= m.least:
            return k, p, sum(map(len, every)), []
    return None


def _classified(documents: DataFrame, handle: Callable, schema: str, kinds: tuple) -> DataFrame:
    """The rows that ``handle(doc_id, label, main language, confidence, characters, paragraphs)`` gives for each document with a language."""
    spark = documents.sparkSession
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    model = fit(sample(documents))
    shipped = spark.sparkContext.broadcast((model.scores, model.bias, model.temperature, model.least))  # of fixed size
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shipped.value)
        for batch in batches:
            out: list[tuple] = []
            for doc, label, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text and (got := parts_of(m, text)):
                    out += handle(doc, label, *got)
            columns = list(zip(*out)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    rows = documents.where(F.length("text") > 0).select("doc_id", label_of(F.col("lang")).alias("label"), "text")
    return rows.mapInArrow(run, schema)


def segments(documents: DataFrame) -> DataFrame:
    """(doc_id, seg_no, lang, confidence, label, chars): segment 0 is the document, k >= 1 a paragraph with running text."""

    def handle(doc: int, label: str, main: int, sure: float, chars: int, parts: list) -> list[tuple]:
        return [(doc, 0, LANGUAGES[main], sure, label, chars), *((doc, n, LANGUAGES[k], p, label, c) for n, k, p, c in parts)]

    return _classified(documents, handle, SEGMENTS, (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.int64()))


def found(documents: DataFrame) -> DataFrame:
    """The documents of at least 60 characters whose label is missing or wrong, and the paragraphs in another language than the main one."""

    def handle(doc: int | None, label: str | None, main: int, sure: float, chars: int, parts: list) -> list[tuple]:
        whole = [(doc, 0, LANGUAGES[main])] if label != LANGUAGES[main] else []
        return whole + [(doc, n, LANGUAGES[k]) for n, k, _, _ in parts if k != main]

    long = documents.where((F.length("text") >= MIN_CHARS) & F.col("doc_id").isNotNull())
    # a document is one row, so nothing but its result moves; the sample is of all labelled rows of that length
    return _classified(long, handle, "doc_id bigint, seg_no bigint, lang string", (pa.int64(), pa.int64(), pa.string())).distinct()
