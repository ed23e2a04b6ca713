"""Small frames with the cases every operator defines."""

from flowlens.llm import runtime

LONG = " ".join(f"w{k % 997}" for k in range(30_000))
ROWS = [
    (1, "alpha beta gamma delta", "s1"), (2, None, "s1"), (3, "", None), (4, LONG, "s2"), (5, "alpha beta gamma delta", "s2"),
    (5, "alpha beta gamma delta", "s2"), (None, "no id here at all", None), (6, "line one\nline one\n\nline two.", "s3"),
    (7, "  \t ", "s3"), (8, "é ß Σ 日本 😀 idiot", "s1"), (9, LONG + " tail", "s2"), (10, LONG, "s2"),
]
# Extra columns whose names the operators use inside.
EXTRA = "lang string, source string, n_chars long, row string, fp string, kept string, score string, bucket string, grp string, ord string"


def frame(spark, rows=ROWS):
    runtime.prepare(spark)
    data = [(i, t, "en", s, None if t is None else len(t), "r", "f", "k", "s", "b", "g", "o") for i, t, s in rows]
    return spark.createDataFrame(data, "doc_id long, text string, " + EXTRA)


def labels(spark, rows=((1, 1, 0), (5, 0, 1), (8, 1, 1), (6, 0, 0), (6, 0, 0), (99, 1, 1), (None, 1, 1), (4, None, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
