import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, score double, comp string, word long"


def make(rows):
    return [(i, t, lang, s, None if t is None else len(t), 7, 0.5, "x", 1) for i, t, lang, s in rows]


def nasty_rows():
    """Copies, near copies, passages, nulls, empty and long texts, ties, and columns with names that operators use."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgehiknorst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = prose(120), prose(60)
    rows = [(0, base, "en", "a"), (1, base, "en", "a"), (2, base.upper(), "en", "b")]
    for k in range(3, 30):
        w = base.split()
        w[rng.randrange(len(w))] = "changed" + str(k)
        if k % 3 == 0:
            w[rng.randrange(len(w))] = "twice"
        rows.append((k, " ".join(w), "en", "a"))
    rows += [(k, prose(40) + "\n" + passage + " " + prose(30), "de", None) for k in range(30, 40)]
    rows += [(40, None, "en", "a"), (41, "", None, "a"), (42, " \t\n ", "fr", "b"), (43, "one", "en", "c"), (44, "ONE", "en", "c"), (45, "one two three four", "en", "c")]
    rows += [(46, "word " * 3000, "en", "a"), (47, "ééé ü 日本語 \U0001f600 " * 60, None, "a"), (48, "x" * 5000, "en", "a"), (49, "\x00﻿▁ a  b   c\r\n\r\nd <|endoftext|> <s>", "en", "a")]
    rows += [(50, prose(20_000), "en", "a"), (51, "a\n" * 50, "fr", "a"), (52, (passage + ". ") * 4, "es", "b"), (53, passage[10:90], "es", "b"), (54, "### $$$ %%% 123", "en", "b")]
    return rows


@pytest.fixture(scope="session")
def nasty(spark):
    return spark.createDataFrame(make(nasty_rows()), SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Without ids, and rows that are there twice."""
    rows = nasty_rows()[:6]
    return spark.createDataFrame(make([*rows, *rows, (None, rows[0][1], None, None), (None, None, None, None)]), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
