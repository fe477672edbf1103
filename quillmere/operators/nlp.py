"""Tokens, stop words, stems, bags of words and topics."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The usual English stop words (fixed values).
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself "
    "it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above "
    "below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such "
    "no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't "
    "doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't "
    "weren weren't won won't wouldn wouldn't"
).split()


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[ \t\r\n\f]+", -1), lambda x: x != "")


def without_stop_words(words: Column) -> Column:
    return F.filter(words, lambda x: ~x.isin(*STOP_WORDS))


def bag_of_words(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token, n)."""
    return documents.select(id_col, F.explode(tokens(F.col(text_col))).alias("token")).groupBy(id_col, "token").agg(F.count("*").alias("n"))


def _vowel(w: str, k: int) -> bool:
    return w[k] in "aeiou" or w[k] == "y" and k > 0 and not _vowel(w, k - 1)


def _measure(w: str) -> int:
    kinds = [_vowel(w, k) for k in range(len(w))]
    return sum(a and not b for a, b in zip(kinds, kinds[1:]))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1)


def _short(w: str) -> bool:
    n = len(w)
    return n > 2 and not _vowel(w, n - 1) and _vowel(w, n - 2) and not _vowel(w, n - 3) and w[-1] not in "wxy"


#: The suffix tables of Porter's paper of 1980, steps 2 to 4 (fixed values).
STEP_2 = (
    "ational ate,tional tion,enci ence,anci ance,izer ize,abli able,alli al,entli ent,eli e,ousli ous,ization ize,"
    "ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble"
)
STEP_3 = "icate ic,ative ,alize al,iciti ic,ical ic,ful ,ness "
STEP_4 = "al,ance,ence,er,ic,able,ible,ant,ement,ment,ent,ion,ou,ism,ate,iti,ous,ive,ize"


def _table(rules: str) -> list[tuple[str, str]]:
    return sorted((tuple(r.split(" ")) for r in rules.split(",")), key=lambda r: -len(r[0]))


_S2, _S3, _S4 = _table(STEP_2), _table(STEP_3), sorted(STEP_4.split(","), key=len, reverse=True)


def stem(word: str) -> str:
    """The stem of a lower-case English word, after Porter."""
    w = word
    if len(w) <= 2:
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            base = w[: -len(end)]
            if w.endswith(end) and any(_vowel(base, k) for k in range(len(base))):
                w = base
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and any(_vowel(w[:-1], k) for k in range(len(w) - 1)):
        w = w[:-1] + "i"
    for table in (_S2, _S3):
        for end, new in table:
            if w.endswith(end):
                if _measure(w[: len(w) - len(end)]) > 0:
                    w = w[: len(w) - len(end)] + new
                break
    for end in _S4:
        if w.endswith(end):
            base = w[: len(w) - len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stems(words: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        known: dict[str, str] = {}

        def one(w: str) -> str:
            if w not in known:
                known[w] = stem(w)
            return known[w]

        return lists.map(lambda x: None if x is None else [one(w) for w in x])

    return run(words)


def topics(documents: DataFrame, k: int = 3, passes: int = 15, seed: int = 1, text_col: str = "text") -> DataFrame:
    """(topic, term, weight): the heaviest terms of each topic, from passes over all documents with all their terms.

    The online optimizer draws its batches with replacement, at a rate of 1 too, so that a pass misses documents."""
    words = documents.where(F.col(text_col).isNotNull()).select(without_stop_words(tokens(F.col(text_col))).alias("words"))
    counter = CountVectorizer(inputCol="words", outputCol="features", vocabSize=2**31 - 1, minDF=1).fit(words)
    model = LDA(k=k, maxIter=passes, seed=seed, optimizer="em").fit(counter.transform(words))
    shown = model.describeTopics(10).collect()  # k rows
    rows = [(r["topic"], counter.vocabulary[t], w) for r in shown for t, w in zip(r["termIndices"], r["termWeights"])]
    return documents.sparkSession.createDataFrame(rows, "topic long, term string, weight double")
