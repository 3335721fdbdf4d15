import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus():
    """Rows with near and exact copies, shared passages, repeated lines, nulls, and one very long text."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abdeinorst") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    line = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n)).capitalize() + "."
    passage = line(60)
    texts = ["\n".join(line(rnd.randint(3, 30)) for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    for k in range(20):  # near copies of text 0: one word changed
        words = texts[0].split(" ")
        words[rnd.randrange(len(words))] = f"edit{k}"
        texts.append(" ".join(words))
    texts += [texts[1]] * 5 + [texts[2] + "\n" + passage, passage, "x " + passage + " y", passage + " " + passage]
    texts += ["", " \n\t", "word", "a b", "é" * 300, "ab" * 400, "\n".join(line(12) for _ in range(300)), None, "Ti.", "Ti."]
    langs = ["en", "de", None]
    return [(k, t, langs[k % 3], [None, "s1", "s2", "S3"][k % 4], len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
