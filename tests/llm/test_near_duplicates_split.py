import random
import re

from quillmere.llm import near_duplicates, split


def files(spark, rows):
    return spark.createDataFrame(
        [(i, t, w, "x", "y") for i, t, w in rows], "file_id long, content string, ingested_at timestamp, id string, band string"
    )


def jaccard(a, b, width):
    x, y = (set(zip(*(re.findall("[a-z0-9]+", t.lower())[k:] for k in range(width)))) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 0


def corpus(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = {}
    for k in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 150))]
        for v in range(rng.randint(1, 4)):
            changed = list(words)
            for _ in range(rng.randint(0, 12)):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            texts[k * 10 + v] = " ".join(changed)
    return texts


def test_pairs_against_brute_force(spark):
    texts = corpus()
    got = {tuple(r) for r in near_duplicates.found(files(spark, [(i, t, None) for i, t in texts.items()])).collect()}
    want = {(a, b) for a in texts for b in texts if a < b and jaccard(texts[a], texts[b], 3) >= 0.6}
    assert want and got == want


def test_defined_cases(spark):
    import datetime as d

    text = " ".join(f"a{k}" for k in range(80))
    old, new = d.datetime(2020, 1, 1), d.datetime(2021, 1, 1)
    rows = [
        (1, text, old), (1, text, new), (2, text.upper(), old), (3, "short", old), (4, None, old), (None, text, old), (5, "", old),
        (6, text, old), (6, "changed " * 100, new), (7, text.replace(" ", " - ") + "\n", None),
    ]
    assert sorted(map(tuple, near_duplicates.found(files(spark, rows)).collect())) == [(1, 2), (1, 7), (2, 7)]
    members = near_duplicates.classes(files(spark, rows)).collect()
    assert {(r["file_id"], r["class_id"]) for r in members} >= {(1, 1), (2, 1), (7, 1)}
    assert near_duplicates.found(files(spark, [])).count() == 0


def test_short_and_null_texts_have_classes(spark):
    import datetime as d

    old, new = d.datetime(2020, 1, 1), d.datetime(2021, 1, 1)
    rows = [
        (1, "a stub of four", old), (2, "a stub of four", old), (2, "a stub of four", old), (3, "another stub", None), (4, None, old), (5, None, new),
        (6, "", old), (7, " \n", old), (8, None, old), (8, "another stub", new), (9, "one two three four five six", old), (None, "a", old), (10, "–", old),
    ]
    got = sorted(map(tuple, near_duplicates.classes(files(spark, rows)).collect()))
    assert got == [(1, 1, 0), (2, 1, 0), (3, 3, 0), (4, 4, 0), (5, 4, 0), (6, 6, 0), (7, 6, 0), (8, 3, 0), (9, 9, 0), (10, 10, 0)]


def test_many_copies_are_one_row_in_the_bands(spark):
    text = " ".join(f"b{k}" for k in range(60))
    near = near_duplicates.NearDuplicates(files(spark, [(k, text, None) for k in range(200)]), 0.6, 3, 50)
    assert near.pairs.count() == 0 and near.members.select("class").distinct().count() == 1


def test_pruning_keeps_what_may_be_similar():
    need = near_duplicates.least_matches(0.6)
    assert (need[1:] > need[:-1]).all() and (need <= 0.6 * near_duplicates.BATCH * (1 + __import__("numpy").arange(len(need)))).all()


def plain_level(text, limit):
    """The level by the letter of its definition, line by line."""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    closed = {}
    k = 0
    while k < len(lines):
        if lines[k][:3] in ("```", "~~~"):
            end = next((j for j in range(k + 1, len(lines)) if lines[j][:3] == lines[k][:3]), None)
            if end is not None:
                closed.update({j: True for j in range(k + 1, end + 1)})
                k = end
        k += 1
    ok = lambda parts: all(len(p.strip()) <= limit for p in parts)
    for level in ("section", "paragraph"):
        parts, now = [], ""
        for j, line in enumerate(lines):
            cut = re.match(r"#{1,6} ", line) or level == "paragraph" and not line.strip()
            if cut and not closed.get(j):
                parts.append(now)
                now = ""
            now += line
        if ok([*parts, now]):
            return level
    if ok(lines):
        return "line"
    if ok([p for line in lines for p in re.split(r"(?<=[.!?])\s+", line)]):
        return "sentence"
    return "word" if ok(text.split()) else "none"


def sample_texts():
    rng = random.Random(4)
    piece = lambda: rng.choice(["# h\n", "\n", "a b. ", "word ", "x" * 30 + "\n", "```\n", "~~~\r\n", "!\n", "longer line of words here\r\n", " \n", "y" * 55 + " "])
    return ["".join(piece() for _ in range(rng.randint(5, 60))) for _ in range(300)]


def test_levels_against_the_definition():
    for text in sample_texts():
        assert split.boundary(text, 60) == plain_level(text, 60), repr(text)


def test_pieces_cover_the_text_within_the_limit():
    for text in sample_texts():
        level, parts = split.pieces(text, 60, 15)
        assert all(b - a <= 60 for a, b in parts)
        covered = set()
        for a, b in parts:
            covered.update(range(a, b))
        assert all(k in covered for k, c in enumerate(text) if not c.isspace())
        for (_, b), (a, _) in zip(parts, parts[1:]):
            assert b - a <= 15


def test_cut_falls_into_the_valley():
    one = "\n\n".join(" ".join(["apple pear plum cherry fruit orchard"] * 6) + "." for _ in range(4))
    two = "\n\n".join(" ".join(["engine wheel brake motor axle garage"] * 6) + "." for _ in range(4))
    text = one + "\n\n" + two
    _, parts = split.pieces(text, 1400, 0)
    assert text[parts[1][0] : parts[1][0] + 6] == "engine"


def test_split_on_spark(spark):
    import datetime as d

    old, new = d.datetime(2020, 1, 1), d.datetime(2021, 1, 1)
    long = ("para graph. " * 100 + "\n\n") * 5
    rows = [(1, long, old), (1, long, new), (2, "short", old), (3, None, old), (None, long, old), (4, " " * 5000, old), (5, "é" * 9001, old), (6, "", old)]
    assert sorted(map(tuple, split.found(files(spark, rows)).collect())) == [(1, "paragraph"), (4, "section"), (5, "none")]
    assert [len(r["text"]) for r in split.split(files(spark, rows)).where("file_id = 5").orderBy("piece_no").collect()] == [4000, 4000, 1001]
    assert split.found(files(spark, [])).count() == 0
