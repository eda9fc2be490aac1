"""Rows that every operator on texts has to take: nulls, empty, very long, tied and repeated texts, clashing columns."""

LONG = " ".join(f"w{i * 7919 % 50021}" for i in range(60_000))
TEXTS = [
    (1, None, "a"),
    (2, "", None),
    (3, " \t\n ", "a"),
    (4, "one two three", "b"),
    (5, "ONE two Three", "b"),
    (6, LONG, "b"),
    (7, LONG + " tail", None),
    (8, "x " * 300, "é"),
    (9, "x " * 300, "é"),
    (10, "Grüße aus Köln.\nGrüße aus Köln.\nund mehr", "Z"),
]
SCHEMA = "doc_id long, text string, source string"


def docs(spark, rows=None):
    """The cases with extra columns named like those the operators make."""
    df = spark.createDataFrame(TEXTS if rows is None else rows, SCHEMA)
    return df.selectExpr("*", "doc_id AS size", "'x' AS target", "1 AS n", "text AS clean_text", "0 AS keys", "array(1) AS _words", "1 AS n_words", "'q' AS digest", "1.0 AS rate")
