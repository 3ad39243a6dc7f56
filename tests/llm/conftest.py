"""Small fixtures that every operator must stand: nulls, empty texts, repeats, clashing columns."""

import random

import pytest

WORDS = [a + b for a in "ba de ki lo mu ne po ri sa tu ve wo".split() for b in "lan dor min tek ros fil gan hur".split()]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(pick, n):
    return " ".join(pick.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Clean, copied, near-copied, passage-sharing, empty, blank, long and odd texts."""
    pick = random.Random(7)
    passage = sentence(pick, 120)
    base = [sentence(pick, pick.randrange(30, 160)) for _ in range(30)]
    found = base + base[:3] + [base[4] + " ending"] + [f"{sentence(pick, 50)} {passage} {sentence(pick, 40)}" for _ in range(4)]
    found += [None, "", "   \n\t", "one", "Äpfel ÉTÉ ñandú <|endoftext|> </s>[INST]", "word " * 300, sentence(pick, 20_000)]
    found += ["a\tb  c\n\n d", "x" * 900, "é" * 600, "\\ \\b \\. back"]
    return found


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With columns whose names operators use inside, and two wholly repeated rows."""
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, "a text without an id", None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    clashing = {c: frame.source for c in ("uid", "fp", "row", "doc", "digest", "words", "length", "key", "n", "term", "pos", "kept", "made", "n_words", "rank", "score")}
    return frame.withColumns(clashing).repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
