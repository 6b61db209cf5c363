"""Small documents that every operator must take: nulls, empty and long texts, repeated rows, clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, idx int, copies string, label string"


def rows():
    base = "The quick brown fox jumps over the lazy dog and runs to the far hill. "
    out = [
        (1, None, "en", "a", None),
        (2, "", None, None, 0),
        (3, " \n\t ", "en", "a", 4),
        (4, base * 6, "en", "a", 10),
        (4, base * 6, "en", "a", 10),  # a repeated row
        (5, base * 6, "en", "b", 10),
        (6, base * 5 + "Something else ends it.", "en", None, 10),
        (None, "no id here", None, "b", None),
        (7, "ünïcödé 😀 wörds\r\nand\x0blines " * 40, "de", "c", 5),
        (8, " ".join(f"w{i % 977}x{i}" for i in range(30_000)), "en", "c", 7),  # very long
        (9, "one", "fr", "b", 3),
    ]
    return [(i, t, la, s, n, "x", 0, "y", "z") for i, t, la, s, n in out]


def docs(spark, n=None):
    return spark.createDataFrame(rows()[:n] if n is not None else rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
