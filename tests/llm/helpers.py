"""Small tables for the operators' edge cases."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, n long, rows long"


def docs(spark, pairs):
    """A documents table, with columns whose names the operators use themselves."""
    return spark.createDataFrame(
        [(i, t, "en", "src0", len(t or ""), "x", 7, 1) for i, t in pairs], DOCS)


def by_id(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out
