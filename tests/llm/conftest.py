import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, row string, own_fp string, spans string"


@pytest.fixture(scope="session")
def hard(spark):
    """Rows with nulls, empty and very long texts, repeats, ties and extra columns whose names operators use inside."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage, body = line(70), "\n".join(line(12) for _ in range(6))
    texts = [body, body, body + " x", passage + "\n" + line(30), line(20) + " " + passage, None, "", "", " ", "one", "\n", "\n\n", line(60_000), "it's naïve 12 ☃️  \t x", passage.upper(), body.replace("a", "b", 1), "All rights reserved.", "GNU General Public License cc by"]
    texts += [line(rng.randint(1, 120)) for _ in range(20)]
    rows = [(i, t, "en" if i % 3 else None, "s", None if t is None else len(t), "k", "r", None, "sp") for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], (None, body, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (-5, passage, None, None, 1, None, None, None, None)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
