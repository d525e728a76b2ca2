"""A small documents table with every odd case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(20_000))
ROWS = [
    (1, "One two three four five six seven eight nine ten eleven twelve.", "a"), (2, None, "a"), (3, "", "b"), (4, "   \n\t ", "b"),
    (5, "Grüße aus Köln, ça va? Ñandú 12½ Σίσυφος", None), (None, "an id is missing here but the text is fine", "c"), (7, LONG, "c"),
    (8, "One two three four five six seven eight nine ten eleven twelve.", None), (9, "x", ""), (9, "x", ""), (9, "x", ""),
    (10, "<|endoftext|> it's  a   test　of\x1cspaces and <b>tags</b>", "a"), (11, "!!! ... ???", "a"), (12, "!!! ... ???", "b"),
]
#: Names that operators use for themselves.
EXTRA = ["key", "h", "bucket", "size", "row", "_copies", "digest", "weight"]


def documents(spark, rows=ROWS):
    schema = "doc_id bigint, text string, source string, " + ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame([(*r, *("z",) * len(EXTRA)) for r in rows], schema)


def texts():
    return [(i, t or "") for i, t, _ in ROWS]
