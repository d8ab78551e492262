"""Small documents with the awkward cases: nulls, blanks, repeats, long texts, clashing column names."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, fp long, _i string, _th string, best string, w string"


def frame(spark, rows):
    """rows of (doc_id, text[, source]) with further columns whose names operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, 2, 3, "x", "y", "z", "w") for r in rows]
    return spark.createDataFrame(full, DOCS)


def awkward(spark, extra=()):
    rows = [(1, None), (2, ""), (3, "  \n\t "), (None, "a text without id here"), (None, None), (4, "word " * 30_000), (5, "same words here again"), (5, "same words here again"), (6, "same words here again")]
    return frame(spark, [*rows, *extra])
