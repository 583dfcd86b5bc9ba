"""Awkward inputs that every operator and every stage has to take."""

CLASHING = "score kept n_words shard virtual_slot row key_a key_b hits spans rank part root fingerprint copies size target repeated n_removed label"

LONG = " ".join(f"wordnumber{i % 9000} of the long text." for i in range(30_000))


def rows():
    """``doc_id, text, lang, source, n_chars`` with nulls, empty and very long texts, ties and repeated rows."""
    plain = "the quick brown fox jumps over the lazy dog and runs away from the many hounds that follow it home tonight."
    other = "completely different words stand here so that nothing of the first text comes back in this second one at all, ever."
    return [
        (1, plain, "en", "a", len(plain)),
        (1, plain, "en", "a", len(plain)),
        (2, plain, "en", "b", len(plain)),
        (3, plain + " yes", None, None, None),
        (None, plain, "en", "a", 3),
        (None, None, None, None, None),
        (4, None, "de", "b", 0),
        (5, "", "de", "b", 0),
        (6, " \n\t ", "de", "c", 4),
        (7, other, "fr", "c", len(other)),
        (7, other + "\n" + plain, "fr", "c", 1),
        (8, LONG, "en", None, len(LONG)),
        (9, "ÄÖ ñ \U0001f600 İ ß, 漢字 &&& | !!", "xx", "c", 9),
        (10, "a b c", "en", "c", 5),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, clashing=False):
    df = spark.createDataFrame(rows(), SCHEMA)
    if clashing:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit("own").alias(c) for c in CLASHING.split()))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    found = [(i, i % 2, (i // 2) % 2) for i in range(1, 11)] + [(None, 1, 1), (1, 1, 0), (2, 1, 1), (3, None, None)]
    return spark.createDataFrame(found, "doc_id long, quality int, toxic int")


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
