import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string, id long, size long, pos int, target double, rank int"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = ["".join(random.Random(i).choices("abcdefghijklmnop", k=3 + i % 5)) for i in range(400)]


@pytest.fixture(scope="session")
def documents(spark):
    """Awkward documents: nulls everywhere, blanks, copies, near copies, shared passages, repeated
    rows and ids, ties, very long texts, and extra columns named like working columns."""
    rng = random.Random(5)
    base = [sentence(rng, 90) for _ in range(6)]
    passage = sentence(rng, 60)
    texts: list[tuple] = [(None, base[0]), (None, None), (1, None), (2, ""), (3, " \t\x0b\n "), (4, "one two"), (5, "One TWO"), (6, "É one two three four five"), (7, "é one two three four five")]
    k = 10
    for b in base:
        texts.append((k, b))
        words = b.split()
        for step in (1, 2, 3):
            words[step * 20] = f"edit{k}{step}"
            texts.append((k + step, " ".join(words)))
        k += 4
    texts += [(100 + i, sentence(rng, 30) + " " + passage + " " + sentence(rng, 30)) for i in range(6)]
    line = "A line that several documents hold, word for word."
    texts += [(200 + i, f"{sentence(rng, 8)}\n{'  ' if i % 2 else ''}{line if i % 3 else line.upper()}\t\n{sentence(rng, 8)}\n{line}") for i in range(5)]
    texts += [(300 + i, base[1]) for i in range(3)] + [(300, base[1]), (300, sentence(rng, 40))]
    texts += [(400, "\n".join(sentence(rng, 12) for _ in range(3000))), (401, "be " * 800), (402, "x" * 1000), (403, "😀 emoji " * 40)]
    sources = ["a", "b", "c", None, "ä", ""]
    rows = [(i, t, None if n % 5 == 0 else "en", sources[n % 6] if n % 4 else "a", None if t is None else len(t), "h", 1, 2, 3, 4.0, 5) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def pairs(documents):
    return [(r["doc_id"], r["text"]) for r in documents.collect()]


@pytest.fixture(scope="session")
def folder(documents, tmp_path_factory):
    """The same documents as tables of a folder, with labels."""
    path = str(tmp_path_factory.mktemp("tables"))
    documents.write.parquet(f"{path}/documents.parquet")
    spark = documents.sparkSession
    labels = [(i, 0, 1 if i % 4 == 0 else 0) for i in range(1, 500)] + [(None, 1, 1), (10, None, None), (11, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path
