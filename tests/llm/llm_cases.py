"""Documents that operators must take without harm, and shared helpers."""

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, size long, h string, key string"


def odd_documents(spark, extra=()):
    """Null columns, empty, blank and long texts, repeated rows, clashing column names."""
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "x", "en", "b"),
        (5, "word " * 30_000, "en", "b"), (6, "same text of a row here\nand a line", "de", "c"), (6, "same text of a row here\nand a line", "de", "c"),
        (None, "a document without an id but with text", "en", "a"), (8, "y" * 200_000, "en", None),
        (9, "nul \x00 and é ß İ 漢字 \U0001f600 end", "", ""), *extra,
    ]
    full = [(i, t, lang, s, None if t is None else len(t), -1, "h", "k") for i, t, lang, s in rows]
    return spark.createDataFrame(full, FIELDS)


def empty_documents(spark):
    return spark.createDataFrame([], FIELDS)
