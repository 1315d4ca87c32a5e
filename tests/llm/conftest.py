import random

import pytest
from pyspark.sql import functions as F

SYLLABLES = "ka lo mi tu ren sol vit bar den fal gor hin".split()


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars): prose, exact and near copies, repeated rows, junk, nulls, empty, blank, one-word and very long texts."""
    rng = random.Random(5)
    texts = [" ".join(words(rng, rng.randint(20, 120))) + "." for _ in range(60)]
    base = words(rng, 200)
    for k in range(12):
        near = list(base)
        near[15 * k % 200] = f"changed{k}"
        texts.append(" ".join(near))
    texts += [texts[0]] * 8 + [texts[1].upper(), "  " + texts[2].replace(" ", "\t\n") + " "]
    texts += ["one", "one", "two words", "", "", " \n ", None, None, " ".join(words(rng, 20_000)), "é漢字 naïve", "#### $$$ ||| !!! " * 30, "SHOUT!! " * 40]
    rows = [(i, t, "en" if i % 2 else None, None if i % 11 == 0 else f"src{'0' if i % 3 == 0 else i % 7}", len(t) if t else None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[3], "en", "src1", 1), (None, None, None, None, None), (7, "another text under an id that is there already", "en", "src2", 3)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """With more columns, whose names are those that operators use inside."""
    df = spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("node", "sig", "h", "at", "cell", "rank", "size", "a", "b", "label", "score", "text_key", "copies", "n_copies", "_id", "bucket", "target", "words", "shard"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(5).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark, corpus):
    rows = [(i, 0 if t and ("$$$" in t or "!!" in t) else 1, 1 if t and "vit" in t else 0) for i, t, *_ in corpus if i is not None and i % 5] + [(None, 1, 1), (3, None, None), (10**9, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
