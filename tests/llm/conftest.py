import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, around string, block string, key string"
SYLLABLES = "ka lo mi ren dus tal ve shor pin gra lun des tro fi bel mon sar qui zet haf".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): copies, near copies in a chain, a shared passage, short, odd, empty, NULL and long texts, a NULL id."""
    rng = random.Random(5)
    passage = prose(rng, 60)
    out = [(i, prose(rng, rng.randint(20, 80))) for i in range(40)]
    base = prose(rng, 120)
    out += [(100 + i, base) for i in range(6)]
    out += [(110 + i, base.replace(" ", "\n", 3).upper()) for i in range(3)]
    words = base.split()
    for i in range(12):  # each differs from the one before in one word more
        words = words.copy()
        words[8 * i + 4] = f"edit{i}"
        out.append((200 + i, " ".join(words)))
    out += [(300 + i, prose(rng, 40) + " " + passage + " " + prose(rng, 40)) for i in range(15)]
    out += [(400, "one two"), (401, "ONE  two"), (402, "one"), (403, ""), (404, None), (405, " \t\n "), (406, "1234 !!"), (407, "One two three four five")]
    out += [(500, prose(rng, 9000)), (None, "one two three four five six"), (None, None), (0, out[0][1]), (0, out[0][1])]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en" if (i or 0) % 3 else None, ["a", "a", "b", None][(i or 0) % 4], None if t is None else len(t), "x", "y", "z") for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
