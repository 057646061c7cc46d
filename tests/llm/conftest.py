import pytest

ROWS = "doc_id long, text string, lang string, source string, n_chars long, `_row` long, `_h` long"

#: Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names.
EDGE = [
    (1, "the cat sat on the mat and then the dog sat on the log by the door " * 4, "en", "a", 1, 1, 1),
    (2, "the cat sat on the mat and then the dog sat on the log by the door " * 4, "en", "a", 1, 1, 1),
    (2, "the cat sat on the mat and then the dog sat on the log by the door " * 4, "en", "a", 1, 1, 1),
    (3, None, None, None, None, None, None),
    (4, "", "en", "b", 0, 0, 0),
    (None, "ein kleiner Hund lief über die Straße und bellte laut", "de", None, 1, 5, 5),
    (None, None, None, None, None, None, None),
    (5, " \n\t ", "en", "b", 4, 2, 2),
    (6, " ".join(f"wordy{i}" for i in range(20_000)), "en", "c", 9, 3, 3),
    (7, "einé 漢字 🎉 <|endoftext|> ▁▁ x\x00y", "fr", "c", 9, 4, 4),
]


@pytest.fixture
def edge(spark):
    return spark.createDataFrame(EDGE, ROWS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], ROWS)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
