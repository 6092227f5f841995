"""Rows and columns that operators must bear."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empty, repeated and tied rows, odd white space, several scripts, and a very long word.
TEXTS = [None, "", " ", "one", "one two", "The quick brown fox jumps over the lazy dog.\nThe quick brown fox.", "a　b\xa0c", "漢字かな交じり文の例です。" * 30, "naïve café – déjà vu\r\n\tx\x0by", "x" * 5000, "  <|endoftext|>  it's we're !!<|endoftext|>", "emoji 👩‍👩‍👧 " * 40, "word " * 3000]


def with_clashing_columns(df):
    """df with more columns under names that operators use inside."""
    for c in ("n", "a", "b", "row", "part", "component", "key", "score", "kept", "ids", "edited"):
        df = df.withColumn(c, F.lit("clash"))
    return df
