import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, size long, h long"


def words(r, n):
    return [r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(r.randint(0, 40)) for _ in range(n)]


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, copies, near copies, shared passages, repeated rows, odd characters."""
    r = random.Random(3)
    long, base, passage = words(r, 12_000), words(r, 120), words(r, 60)
    texts = [None, "", "  \n\t ", "one", "one two three", "one two three", " ".join(long), " ".join(base), " ".join(base)]
    for k in range(24):  # a large group of near copies
        near = list(base)
        near[(5 * k) % 120] = f"changed{k}"
        texts.append(" ".join(near))
    for _ in range(24):  # a passage that many documents share
        texts.append(" ".join(words(r, 20) + passage + words(r, 25)))
    texts += ["Ünïcode ▁ text\x00 with 漢字 and 😀\r\nlines\x0b here", "A B C D E F", "a b c d e f", "x<|startoftext|>y <|endoftext|> don't STOP,now! 12.5", "\n".join(["same line here"] * 4)]
    texts += [" ".join(words(r, r.randint(1, 90))) for _ in range(30)]
    rows = [(k, t, "en" if k % 2 else None, f"src{k % 3}", None, "x", 1, 2) for k, t in enumerate(texts)]
    return [*rows, rows[7], (None, "text of a row without an id", None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
