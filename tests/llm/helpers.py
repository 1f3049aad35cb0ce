"""Small tables for the operator tests."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
# names that the operators use inside
EXTRA = ["m", "pattern", "kept", "fp", "root", "copy", "h", "w", "pos", "s", "e", "a", "b", "cell", "g", "host", "template", "unit", "length"]


def docs_frame(spark, rows, extra=False):
    """Documents from (doc_id, text[, source]); ``extra`` adds clashing columns."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", None if r[1] is None else len(r[1])) for r in rows]
    if not extra:
        return spark.createDataFrame(full, DOCS)
    schema = T.StructType(DOCS.fields + [T.StructField(c, T.StringType()) for c in EXTRA])
    return spark.createDataFrame([r + tuple(f"x{c}" for c in EXTRA) for r in full], schema)


PROSE = "The quick brown fox jumps over the lazy dog while seven grey geese fly south along a quiet river bank near town"


def long_text(n):
    return " ".join(f"word{i}" for i in range(n))
