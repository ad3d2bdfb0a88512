"""Small document tables that hold the awkward rows."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or return; extra columns that clash with them.
CLASHES = ["key", "node", "score", "copy", "position", "run", "guest", "lang_pred", "lang_score", "spans", "words", "n_words", "seed", "block", "anchor", "component_id", "tokenizer", "digest", "fp", "row", "id", "hash", "doc", "hit_id", "hit_hash", "gone_id", "text_hash", "u", "n", "cdf", "rate", "parts", "root", "group", "bands", "best", "shard", "start", "block_id", "__node", "__best", "__source", "__cdf", "__u", "__n", "__id"]


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCS)


def awkward(spark):
    """Nulls in every column, an empty text, blanks only, a repeated row, ties, a long text, and columns with clashing names."""
    long = " ".join(f"word{i % 700} tail{i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one two three four five six seven"), (4, "one two three four five six seven"), (5, "one two three four five six seven"), (None, "a text without an id"), (None, None, None, None), (6, long), (7, "émile ÉCOLE été", None, None), (8, "x" * 30_000)]
    df = docs(spark, rows)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def empty(spark):
    return docs(spark, [])


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
