"""Small tables with nulls, empty and very long texts, ties, repeated rows and
extra columns whose names clash with result columns."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, rank int, "
          "component_id long, n_tokens long, score double, text_sha256 string, target double")


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def row(doc_id, text, source="s"):
    return (doc_id, text, "en", source, None, None, 7, 1, 3, 5, 0.5, "x", None)


def edge_rows():
    a, b = words(60, 1), words(80, 2)
    near = a.split()
    near[30] = "changed"
    return [
        row(1, a, "a"), row(2, a.replace(" ", "  ", 3) + "\n", "b"), row(3, " ".join(near), "a"), row(4, b, None),
        row(4, b, None), row(4, b, None), row(None, a, "a"), row(None, None, "b"), row(5, None, "c"),
        row(6, "", "c"), row(7, " \t\r\n\x0b\x0c", None), row(8, "one", "é"), row(9, "one two three", "Z"),
        row(10, words(30000, 3), "a"), row(11, "x" * 20000, "b"), row(12, "é中😀 ½ \x85\xa0 a\x1cb", "b"),
        row(13, "0" * 30000 + "@", "c"), row(14, b.upper(), "b"),
    ]


def edge_docs(spark, partitions=3):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(partitions)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def tuples(df, *cols):
    """Rows as sorted tuples, nulls first."""
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()),
                  key=lambda t: tuple((x is not None, x) for x in t))
