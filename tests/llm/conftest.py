import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    """Invented documents with copies, near copies, shared passages, nulls, empty and long texts."""
    rng = random.Random(seed)
    syl = "an be ta ro ki lu me so di na".split()
    word = lambda: "".join(rng.choice(syl) for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(60)]
    texts = []
    for i in range(n):
        w = [word() for _ in range(rng.choice([3, 30, 120, 400]))]
        for k in range(9, len(w), 17):
            w[k] += rng.choice([".", ",", "\n", "! "])
        if i % 7 == 3:
            w[5:5] = passage[: rng.choice([13, 20, 60])]
        texts.append(" ".join(w))
    for i in range(0, n, 5):
        texts.append(texts[i])
    for i in range(0, n, 4):
        w = texts[i].split(" ")
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += ["", "   \n\t ", "one", "One", "a b c d", "x " * 300, "Ünïcödé   wörds ​ and 中文 text 😀 " * 9]
    texts += [" ".join(word() for _ in range(6000))]
    rows = [(i, t, rng.choice(["en", "de"]), "src0", len(t)) for i, t in enumerate(texts)]
    return rows + [(len(rows), None, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(3).cache()


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, repeated rows, ties."""
    return spark.createDataFrame(
        [(None, None, None, None, None), (None, "some words here", "en", None, 3), (7, None, None, "s", None), (7, "twice", "en", "s", 5), (7, "twice", "en", "s", 5), (8, "", "en", "s", 0)] + [(9, "the same long row " * 20, "en", "s", 1)] * 3,
        DDL,
    ).coalesce(1)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def sf(spark, docs, rows, tmp_path_factory):
    """A folder with documents and labels."""
    at = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), int("idiot" in (t or ""))) for i, t, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at
