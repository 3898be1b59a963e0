"""Small tables with every kind of row an operator must bear."""

LONG = " ".join(f"w{i % 4000}x{i % 7}" for i in range(30_000))
PLAIN = "the quick brown fox jumps over one lazy dog while eleven small birds look on from a tall old tree"
ROWS = [(0, PLAIN, "a"), (1, PLAIN, None), (2, None, "b"), (3, "", "b"), (4, "   \n\t ", "b"), (5, LONG, "c"), (None, PLAIN + " extra", "d"),
        (6, "é ß 中文 word", "e"), (7, PLAIN.upper(), "e"), (7, PLAIN.upper(), "e"), (None, None, None)]
SCHEMA = "doc_id long, text string, source string"
# Names that results use, on columns of the input.
CLASH = ["n_words", "kept", "id", "fp", "items", "secrets", "entities", "length", "offset", "found", "score", "contaminated", "h", "c"]


def rows(spark, data=None):
    return spark.createDataFrame(ROWS if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark):
    df = rows(spark)
    for name in CLASH:
        df = df.withColumn(name, df["source"])
    return df
