import pytest

LONG = "lorem ipsum dolor sit amet " * 9000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, and columns with names that operators use inside."""
    texts = ["", None, " \n\t ", "a", "one two three", "one two three four five six", "l1 x\nl2 y\nl3 z\nl4", LONG, "<|endoftext|> and <|startoftext|>", "ÀÉ ß Σ 漢字 \x00 é́"]
    rows = [(i, t, "s" if i % 3 else None) for i, t in enumerate(texts)]
    rows += [(4, texts[4], "s"), (4, "another text of the same id here", "s"), (None, "no id at all", "s"), (None, None, None), (5, texts[5], None)]
    names = "size long, key string, n int, id long, tag string, shard int, label string, pos int, node long, held_out int, n_lines int, score string, length int"
    filler = (1, "k", 1, 1, "t", 1, "l", 1, 1, 1, 1, "s", 1)
    return spark.createDataFrame([r + ("en", len(r[1] or "")) + filler for r in rows], f"doc_id long, text string, source string, lang string, n_chars long, {names}")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
