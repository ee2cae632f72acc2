"""Small documents with the cases that every operator has to handle."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, _id string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def soup(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    parts = ["the", "er", "tion", "and", "ing", "ou", "re", "st", "ha", "é"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)]


def edited(words: list[str], seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


def rows(texts: list) -> list[tuple]:
    """Rows of the documents table with two extra columns whose names clash with those that operators use."""
    return [(i, t, "en", f"src{i % 3}", None if t is None else len(t), "x", None) for i, t in enumerate(texts)]


def corpus() -> list:
    base, other = soup(1, 160), soup(2, 120)
    texts = [" ".join(base), " ".join(base), None, "", "  \n\t ", "One.", " ".join(edited(base, 3, 2)), " ".join(edited(base, 4, 3))]
    texts += [" ".join(soup(5, 40) + base[20:100] + soup(6, 30)), " ".join(other), " ".join(other[:119]), "\n".join(" ".join(soup(7 + k % 4, 12)) for k in range(9))]
    texts += ["\n".join([" ".join(soup(7, 12)), " ".join(edited(soup(8, 12), 1, 1)), " ".join(soup(9, 12)[:-1]), "De."]), "a b c d", "A B c D", " ".join(["De"] * 300), " ".join(soup(20, 6000))]
    return texts


def table(spark, texts: list):
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def with_nulls(spark, texts: list):
    """The documents, one of them twice, and rows with null ids and nulls in every column."""
    extra = [(0, texts[0], "en", "src0", len(texts[0]), "x", None), (None, texts[0], None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows(texts) + extra, SCHEMA).repartition(3)
