import pytest

LONG = " ".join(f"word{i % 977} tail{i % 13}" for i in range(30_000))
CLASHES = "n, id, key, same, score, part, row, size, items, component, leader, kept, digest, label, value"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    base = [
        (1, "The quick brown fox jumps over the lazy dog and runs away from it all", "en", "a", 10),
        (2, "the QUICK brown fox jumps over the lazy dog and runs away from it all", "en", "a", 10),
        (2, "the QUICK brown fox jumps over the lazy dog and runs away from it all", "en", "a", 10),
        (3, "", None, None, None),
        (4, None, "en", "b", 0),
        (5, LONG, "de", "b", 1),
        (None, "a text without an id that is here", "fr", "c", 5),
        (6, "!!! ... 123 $$$", None, "c", 5),
        (7, "a" * 50_000, "en", "c", 5),
        (8, " \t\n ", "es", "c", 5),
        (9, "<|endoftext|>héllo wörld ñandú <|endoftext|> 日本語テキスト 🙂", "fr", "c", 5),
        (10, "Le chat est dans la maison avec les enfants et une amie", "fr", "d", 5),
        (11, "Der Hund ist nicht in dem Haus und die Katze auch nicht", "de", "d", 5),
    ]
    rows = [(*r, *range(15)) for r in base]
    extra = ", ".join(f"{c.strip()} int" for c in CLASHES.split(","))
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
