import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, extra=False):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", f"s{k % 3}" if k % 7 else None, None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        df = spark.createDataFrame(rows, DOCS).repartition(3)
        if extra:  # names that operators use themselves
            for c in ("node", "token", "key", "doc", "tag", "size", "score", "columns", "_kept", "file", "path"):
                df = df.selectExpr("*", f"'x' AS {c}")
        return df

    return make


def random_words(rng, n, vocabulary=60):
    return " ".join(rng.choice([f"w{i}" for i in range(vocabulary)]) for _ in range(n))
