import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Builds documents from (id, text) or (id, text, source)."""

    def build(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return build


@pytest.fixture
def clashing():
    """Adds columns whose names operators might use themselves."""

    def add(df):
        from pyspark.sql import functions as F

        names = ("_gone", "_lines", "_holder", "key", "version", "block", "nth", "_task", "_nth", "rank", "score", "fingerprint", "digest", "revisit", "piece_of", "slot")
        return df.select("*", *[F.lit("x").alias(n) for n in names if n not in df.columns])

    return add


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


