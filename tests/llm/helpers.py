"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing names."""

LONG = " ".join(f"word{i % 977} the of" for i in range(30_000))

TEXTS = [
    (1, "The cat sat on the mat and the dog lay by the door of the house in the sun."),
    (2, "The cat sat on the mat and the dog lay by the door of the house in the sun."),
    (2, "The cat sat on the mat and the dog lay by the door of the house in the sun."),
    (2, "another text under the same id"),
    (3, None), (4, ""), (5, " \t\n"), (None, "a row without an id"), (None, None),
    (6, LONG), (7, "É ß <s> [INST] \\ 日本 😀\u00a0x\x00y"), (9_007_199_254_740_993, "a very large id"),
]


def documents(spark, rows=TEXTS):
    """With extra columns named like those that operators make."""
    rows = [(i, t, "x", 1, 2, [3]) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, size int, row int, words array<int>")


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))
