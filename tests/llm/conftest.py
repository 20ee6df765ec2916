from __future__ import annotations

import pytest

pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid long, t string, digest string, c long, word string, rep long, hi long, shard int, cell int, n long"

WORDS = [f"w{i}x" for i in range(60)]


def row(doc_id, text, lang="en"):
    """A document with extra columns whose names clash with internal ones."""
    return (doc_id, text, lang, "s", None if text is None else len(text), 7, "x", "y", 3, "z", 1, 2, 3, 4, 5)


@pytest.fixture(scope="session")
def edge_rows():
    long = " ".join(WORDS[i % 60] + str(i // 60) for i in range(30_000))
    return [
        row(1, "One two three four five six seven eight nine ten eleven twelve."),
        row(2, "one TWO three four five six seven eight nine ten eleven twelve."),
        row(3, None), row(4, ""), row(5, "   \n\t "), row(None, "A text of a row without an id, which is long enough to have shingles."),
        row(6, long), row(7, long + " end"), row(8, "1234 5678 ###"), row(9, "a"), row(9, "a"),
        row(10, "One two three four five six seven eight nine ten eleven twelve."), row(11, "un deux trois quatre", None), row(12, "日本語 のテキスト 🙂 é x"),
        row(-5, "One two three four five six seven eight nine ten eleven twelve."),
    ]


@pytest.fixture()
def edge(spark, edge_rows, tmp_path):
    """As a table, in three files."""
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(edge_rows, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture()
def empty(spark, tmp_path):
    path = str(tmp_path / "empty.parquet")
    spark.createDataFrame([], DOCS).write.parquet(path)
    return spark.read.parquet(path)
