import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, digest string, fp int, h string, "
          "features string, score string, text_key string, _b int, length string")


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, parts=3):
        """Documents of (doc_id, text, lang), with further columns whose names the operators use themselves."""
        full = [(i, t, lang, None, None if t is None else len(t), "x", 1, "y", "z", "s", "k", 2, "l")
                for i, t, lang in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


@pytest.fixture(scope="session")
def messy(make_docs):
    """Nulls in every column, empty and very long texts, ties, repeated rows, unusual signs."""
    long_text = " ".join(f"word{i % 997}x{i}" for i in range(30_000))
    rows = [(1, None, None), (2, "", "en"), (3, " \t\n ", "fr"), (4, "one", None), (5, "one  two", "en"),
            (6, "one two", "en"), (6, "one two", "en"), (None, "no id here at all", "de"), (None, None, None),
            (8, long_text, "en"), (9, "9 !! ££ 12,5", "es"), (10, "Größe ß İ Σς 日本語 😀 á \x1c \x85 x", "de"),
            (11, "<|endoftext|> it's we'll \"q\"", "en"), (12, long_text, "en")]
    return make_docs(rows)
