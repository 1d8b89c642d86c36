import random

import pytest

EDGE = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (4, "one", "en", "a"),
    (5, "one two three four five six", "en", "a"), (5, "one two three four five six", "en", "a"),
    (6, "x" * 30_000, "de", "b"), (7, "wort " * 9_000, "de", "b"), (None, "no id at all here", "en", "b"),
    (8, "ein  zwei\n\nein  zwei\nendë 🎉", "de", "b"), (9, "a\x00b ▁ c", "fr", "c"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, and a column with a result's name."""
    rows = [(*r, "mine") for r in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    """Invented documents with exact and near copies, common lines and shared passages."""
    rng = random.Random(5)
    letters = ["ka", "lo", "mi", "ré", "tu", "sen", "vor", "ß"]

    def sentence(n):
        return " ".join("".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(n))

    texts = ["\n".join(sentence(rng.randint(3, 40)) for _ in range(rng.randint(1, 5))) for _ in range(120)]
    passage = sentence(60)
    for i in range(0, 30, 3):
        texts.append(texts[i])
        words = texts[i + 1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
        texts.append(f"{sentence(9)} {passage} {sentence(7)}")
    for i in range(0, len(texts), 2):
        texts[i] += "\nall rights kept by this house"
    rows = [(i * 7 % 1009, t, "en" if i % 3 else "de", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"
    ).repartition(5).cache()
