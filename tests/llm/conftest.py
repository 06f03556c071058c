import random

import pytest

ODD = "id long, text string, score double, rank int, component_id string"


@pytest.fixture(scope="session")
def corpus(spark):
    """Null, empty, blank, short, repeated and long texts, a null id, and columns whose names the operators use too."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 8)))
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two three"), (6, "one two three"), (6, "one two three"), (None, "one two three"), (7, "äöü ß ñ 日本語 123 <|endoftext|> x")]
    rows += [(10 + i, " ".join(word() for _ in range(rng.randint(1, 80)))) for i in range(30)]
    rows.append((99, "".join(rng.choice("abcdefgh") for _ in range(9000)) + " tail " + " ".join(word() for _ in range(3000))))
    return spark.createDataFrame([(i, t, 0.5, 1, "x") for i, t in rows], "doc_id long, text string, score double, rank int, component_id string")


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, vec_id long, embedding array<float>, page_id long, url string, html string, toxic int")
