"""Small tables with the awkward cases that every operator must take."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

WORDS = "the of and thion erea stoning blean ther wharen ondre lyest inha thonre edea anst orer".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for k in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        word = WORDS[(x >> 8) % len(WORDS)] + ("" if (x >> 13) % 3 else str((x >> 16) % 97))
        out.append(word + (".\n" if k % 11 == 10 else " "))
    return "".join(out).strip()


def awkward() -> list[tuple]:
    base = prose(1, 60)
    rows = [
        (10, base, "en", "a", 1),
        (11, base, "en", "a", 1),
        (12, base.replace("thion", "thian", 1), "en", None, None),
        (13, None, None, None, None),
        (14, "", "en", "a", 0),
        (15, " \n\t ", "en", "b", 3),
        (16, "one", "en", "b", 3),
        (17, "The the THE the the the the the the the the the", "en", "b", 3),
        (18, prose(5, 9000), "en", "b", 3),
        (19, "a b  c\r\n\td \n e", "fr", "c", 3),
        (20, "Ünï çödé — ok\x00   x", "fr", "c", 3),
        (21, base + "\n" + prose(9, 40), "en", "c", 3),
    ]
    return rows + [(30 + k, prose(100 + k, 25 + k), "en", "d", 1) for k in range(8)]


def table(spark, rows, extra: bool = False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:  # names that operators might use themselves
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit(1).alias(x) for x in ("ids", "start", "h", "n", "part", "shard", "kept", "score", "rank", "pos", "words", "host")))
    return df
