"""Small tables with everything that may be odd about documents."""

BIG = 2**60 + 1
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, score string, component_id string, copies string"


def documents(spark, rows, schema=SCHEMA):
    """rows: (doc_id, text) or (doc_id, text, source); the other columns' names clash with what operators make."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", "x", "x", "x") for r in rows]
    return spark.createDataFrame(full, schema)


def odd(spark):
    """Null ids and texts, an id above 2 ** 53, empty and white-space texts, repeated rows, a very long text."""
    long = " ".join(f"word{i % 997} of{i % 89}" for i in range(40_000))
    return documents(spark, [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None), (2, None), (3, ""), (4, " \t\n "), (BIG, "a  b\tc d"), (5, long, None), (6, "x\ny\n" * 50)])


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}
