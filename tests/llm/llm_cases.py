"""Small tables with the awkward rows that every operator must take."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row int, token string, name string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


def edited(text: str, seed: int, edits: int) -> str:
    rng = random.Random(seed)
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = "edit" + str(rng.randrange(10 ** 6))
    return " ".join(words)


def awkward_texts() -> list[tuple]:
    """(doc_id, text, lang, source): nulls, empty, blank, tiny, copies, near copies, shared passages, long, repeated rows."""
    base, passage = prose(1, 160), prose(2, 60)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, edited(base, 3, 2), "en", "b"), (4, edited(base, 4, 3), None, None),
        (5, prose(5, 80) + " " + passage + " " + prose(6, 40), "fr", "b"),
        (6, passage + "\n" + prose(7, 30), "fr", "c"), (7, prose(8, 20) + "\n" + passage, "fr", "a"),
        (8, None, "en", "a"), (9, "", None, "b"), (10, " \n\t ", "en", None), (11, "one", "en", "a"), (12, "ONE", "en", "a"),
        (13, "one two three four", "en", "a"), (14, "One Two three four", "en", "a"), (15, "é" * 40 + "xyz" + "è" * 40, "fr", "c"),
        (16, "é" * 40 + "xyy" + "è" * 40, "fr", "c"), (17, "ab" * 70, "en", "c"), (18, "ba" * 65, "en", "c"),
        (19, prose(9, 12000), "en", "a"), (20, "日本語のテキスト 😀😀 " * 9, None, "c"), (21, "日本語のテキスト 😀😀 " * 12, None, "c"),
        (22, base.upper(), "en", "b"), (23, "\n".join([prose(10, 12)] * 4 + ["", " ", prose(11, 12)]), "en", "b"),
        (None, base, "en", "a"), (None, prose(12, 50), None, None), (24, prose(13, 30), "en", "b"), (24, prose(13, 30), "en", "b"),
        (25, prose(14, 90), "en", "b"), (25, edited(prose(14, 90), 1, 1), "en", "b"), (-3, edited(base, 8, 1), "en", "z"),
    ]
    return rows


def frame(spark, rows):
    """Rows as documents with extra columns whose names clash with names used inside."""
    full = [(*r, None if r[1] is None else len(r[1]), "x", 7, "t", "n") for r in rows]
    return spark.createDataFrame(full, SCHEMA)
