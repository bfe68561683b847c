import random

import pytest


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "théta", "iota", "kappa", "LAMBDA"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source, n_chars): copies, near copies, shared passages, nulls, empty, long and repetitive texts, a repeated row."""
    rng = random.Random(5)
    passage, long_ = words(rng, 90), words(rng, 6000)
    out = [(i, words(rng, rng.randrange(1, 160))) for i in range(30)]
    out += [(40 + i, f"{words(rng, rng.randrange(0, 50))} {passage} {words(rng, rng.randrange(0, 50))}") for i in range(8)]
    out += [(60 + i, out[3][1]) for i in range(4)] + [(70, out[5][1].upper()), (71, out[5][1].replace(" ", "\n\t"))]
    near = words(rng, 300).split()
    for i in range(6):
        edited = list(near)
        edited[rng.randrange(300)] = f"edit{i}"
        out.append((80 + i, " ".join(edited)))
    out += [(90, None), (91, ""), (92, "  \n "), (93, "x " * 700), (94, "ab" * 900), (95, long_), (96, long_[:-3]), (97, "q"), (97, "q"), (98, None)]
    sources = ["b", "a", None, "ç"]
    return [(i, t, "en", sources[i % 4], len(t or "")) for i, t in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns whose names clash with operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    return df.withColumns({c: F.lit(c) for c in ("dk", "tag", "digest", "fp", "key", "size", "score", "rank", "component_id", "locator", "norm")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
