import public_tokenizers
import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"

UNDERSCORED = ["'x' AS _key", "'x' AS _GUESS", "2.5 AS _leaks", "'x' AS _fit", "2 AS _copies", "'x' AS _row", "3 AS _rows", "true AS _copy", "'x' AS __key"]


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with columns whose names clash with results."""
    def make(rows, **extra):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOC).selectExpr("*", "'x' AS start", "'x' AS size", "'x' AS pack", "'x' AS path", "'x' AS score", "1.5 AS component", "2 AS copies",
                                                            "3 AS rows", "'x' AS fp", "'x' AS key", "'x' AS leaks", "1 AS node", "true AS accepted", *UNDERSCORED)
    return make


@pytest.fixture(scope="session")
def tokenizer():
    return public_tokenizers.path("word_bpe_49k.json")
