"""Edge-case documents: nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n int, key string, kept boolean, words string, bucket string, start string"


def edge_rows():
    plain = "the quick brown fox jumps over the lazy dog near the old river bank today"
    rows = [
        (1, plain),
        (2, plain),
        (2, plain),
        (3, None),
        (4, ""),
        (5, " \t\n "),
        (None, plain + " again"),
        (None, None),
        (6, "x"),
        (7, "one two"),
        (8, "long words here " * 4000),
        (9, "a" * 30_000),
        (7, "another row of the same id, with é ü ß"),
        (10, plain.replace("fox", "cat")),
    ]
    return [(i, t, None, None, None, None, None, None, None, None, None) for i, t in rows]


def edge(spark):
    return spark.createDataFrame(edge_rows(), COLUMNS)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def label_table(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
