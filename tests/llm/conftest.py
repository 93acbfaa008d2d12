import random

import pytest


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows with copies, shared passages, nulls, blanks, a long text, repeated rows and clashing extra columns."""
    rng = random.Random(3)
    passage = words(rng, 60)
    texts = {n: "\n".join(words(rng, rng.randint(5, 20)) for _ in range(rng.randint(1, 9))) for n in range(60)}
    for n in range(60, 75):
        texts[n] = texts[n - 60]
    for n in range(75, 90):
        texts[n] = texts[n - 60] + " w1"
    for n in range(90, 110):
        texts[n] = words(rng, 15) + "\n" + passage + "\n" + words(rng, 9) + "\n" + words(rng, 12)
    texts[110] = "\n".join(words(rng, 12) for _ in range(2500)) + "\n" + texts[5]
    texts |= {111: "", 112: None, 113: " \n\t ", 114: "w1 w2", 115: "\n".join(["w1 w1 w1"] * 40), 116: "é𝄞 ünïcode " + passage}
    rows = [(k, v, "en", "s", 0 if v is None else len(v), k, "x", 1.5) for k, v in texts.items()]
    rows += [(None, texts[7], "en", "s", 1, 0, "x", 1.5), (None, None, None, None, None, None, None, None), rows[3], rows[3], rows[95]]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, starts string, fp double"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
