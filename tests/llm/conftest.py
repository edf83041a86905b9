import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, sig string, size string, kept string, _text string, _spans string, read string, score string"


@pytest.fixture(scope="session")
def texts():
    """Small documents with copies, near copies, shared passages, nulls, empties, ties and one long text."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)] + ["Été", "naïve,", "don't", "x.", "ΑΒ", "漢字", "!!"]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    base, passage = say(140), say(70)
    docs = [" ".join(say(rng.randrange(1, 200))) for _ in range(60)]
    docs += [" ".join(base)] * 3
    for _ in range(25):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(9)}"
        docs.append(" \n".join(w))
    docs += [" ".join(say(30) + passage + say(30)) for _ in range(6)]
    docs += [None, "", "  \t ", "one", "One", "a b c d", "a  b c d", "a b c d e", " ".join(say(9000))]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "a", "b", "c", "d", "e", "f", "g") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
