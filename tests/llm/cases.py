"""Awkward documents that every operator must take."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i % 97}x{i}" for i in range(300)]
PROSE = " ".join(WORDS[:120]) + "."
LONG = " ".join(f"t{i % 5000}" for i in range(60_000)) + "z" * 50_000

ROWS = [
    (1, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (3, PROSE.replace("w5x5", "other"), "en", None, 1), (4, None, "en", "b", None), (5, "", None, "b", 0),
    (6, " \t\n ", "de", "b", 3), (7, "one two", "de", "b", 7), (8, "One  TWO", "de", "b", 8), (9, LONG, "en", "b", len(LONG)), (None, "call +1 (202) 555-0143 or a.b@c.example.org", "en", "b", 1),
    (10, "é́ ß <|endoftext|> \U0001f389 ​ 1.2.3.4\n\n1.2.3.4", None, None, 1),
]


def documents(spark, rows=ROWS):
    """With extra columns whose names the operators could trip over."""
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.withColumns({"n": F.lit("x"), "w": F.lit(1), "node": F.lit("y"), "kept": F.lit(0), "digest": F.lit("d"), "score": F.lit("s"), "kind": F.lit("k"), "item_id": F.lit(9), "bucket": F.lit(3)})


def labels(spark):
    rows = [(1, 1, 0), (1, 1, 0), (2, 1, None), (3, None, 1), (None, 1, 1), (9, 0, 1), (777, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
