import pytest

ODD = "\x0b"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and odd texts, ties, repeated rows, a long text, and columns that clash with results."""
    line = "This line is common to some of them"
    passage = " ".join(f"w{i}" for i in range(70))
    rows = [
        (0, "", "en", "a"), (1, None, "en", "a"), (2, " \t\n" + ODD, None, None), (3, "123 456 !!", "de", "b"),
        (4, f"{line}\nown words of four\n{line.upper()}  ", "en", "a"), (5, f"  {line}\nown words of five", "en", None),
        (6, "one two three four", "en", "b"), (7, "ONE two  three\tfour", "fr", "b"), (8, passage + " tail of eight", "en", "a"),
        (9, "start of nine " + passage, "en", "c"), (9, "start of nine " + passage, "en", "c"), (10, passage.upper(), "es", "c"),
        (11, "été déjà vu, ça va?\n" * 40, "fr", "c"), (12, "x" * 70_000, "en", "a"), (13, "long text of many words " * 30_000, "en", "a"),
        (14, "a <|endoftext|> b<|startoftext|>c  d\x1ce", "en", "b"), (None, "a row without an id and without much else", "en", "a"),
        (15, "one two three four", "en", "a"), (16, None, None, None), (17, f"{line}\n{line}", "en", "b"),
    ]
    rows = [(*r, None if r[1] is None else len(r[1]), -1, "x", 0.5, True, 7, "y") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, kept string, score double, held_out boolean, n_lines int, component string")


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory, edge_docs):
    """A folder of tables: the odd documents, and empty ones of the others."""
    at = tmp_path_factory.mktemp("tables")
    edge_docs.write.parquet(f"{at}/odd/documents.parquet")
    edge_docs.limit(0).write.parquet(f"{at}/empty/documents.parquet")
    labels = spark.createDataFrame([(4, 1, 1), (4, 1, 1), (5, 0, 0), (None, 1, 1), (6, None, None), (99, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{at}/odd/labels.parquet")
    labels.limit(0).write.parquet(f"{at}/empty/labels.parquet")
    pages = [(1, "http://a", "<p>same</p>"), (2, "http://b\r\nX: y", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 60_000), (None, "u", "<p>lone</p>"), (6, "u", "<p>" + "\r\n0\r\n\r\n" * 9000)]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    frame.write.parquet(f"{at}/odd/pages.parquet")
    frame.limit(0).write.parquet(f"{at}/empty/pages.parquet")
    vectors = [(i, [float((i * k) % 7 - 3) / 3 for k in range(4)], 0) for i in range(120)] + [(150, None, 0), (200, [1.0, None, 0.0, 0.0], 0), (250, [float("nan"), 0.0, 0.0, 0.0], 0), (300, [1.0], 0), (None, [1.0, 1.0, 1.0, 1.0], 0), (350, [], 0), (400, [-3.0, 2.0, 0.01, -0.01], 0)]
    frame = spark.createDataFrame([(*v, 1.5) for v in vectors], "vec_id long, embedding array<float>, label int, score double")
    frame.write.parquet(f"{at}/odd/embeddings.parquet")
    frame.limit(0).write.parquet(f"{at}/empty/embeddings.parquet")
    return str(at)
