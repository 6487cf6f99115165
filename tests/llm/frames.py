"""Small tables with every odd case: nulls, empty and very long texts, ties, repeated rows, extra columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, items string"
LONG = " ".join(f"w{k % 997}x{k % 31}" for k in range(30_000))
PROSE = "the quick brown fox jumps over the lazy dog and runs away from the noise of the town at night"


def docs(spark, extra=()):
    rows = [
        (1, PROSE, "en"), (2, PROSE, "en"), (2, PROSE, "en"), (3, PROSE.replace("lazy", "sleepy") + " indeed", "en"), (4, None, "en"), (5, "", None), (6, " \n\t ", "en"),
        (7, LONG, "en"), (8, LONG + " tail", "de"), (9, "one two", None), (10, "ONE  two", "en"), (None, "a row without an id", "en"), (11, "¿ñ? 漢字 😀", "es"),
        *extra,
    ]
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 3, "x") for i, t, lang in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
