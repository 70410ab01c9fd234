"""Small tables with the rows that operators stumble over."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with those that operators make.
EXTRA = "score double, k1 string, text_crc32 string, shard string, size string, fp string, rank int, h string, copy string, bucket string, word string"


def prose(rng, n, words=("the", "sun", "rises", "over", "old", "hills", "and", "a", "river", "runs", "past", "green", "fields", "to", "town", "where", "we", "live", "in", "peace")):
    return " ".join(rng.choice(words) + str(rng.randint(0, 30)) for _ in range(n))


def documents(spark, extra=False):
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    rows = [(k, t, "en", f"src{k % 4}", len(t)) for k, t in enumerate(texts)]
    long = prose(rng, 20_000)
    near = texts[5] + " " + prose(rng, 60)
    rows += [
        (100, None, None, None, None), (101, "", "en", "src0", 0), (102, " \n\t ", "en", None, 4), (103, long, "en", "src1", len(long)), (104, texts[5], "en", "src2", 1),
        (105, texts[5], "en", "src2", 1), (106, near, "en", "src1", 1), (106, near + " end", "en", "src1", 1), (7, texts[7], "en", "src3", 1), (None, texts[8], "en", "src0", 1),
        (None, "lonely words in here", "en", "src0", 1), (-5, "ÀÉ ß 漢字  x y \x1c z", "fr", "ünï", 1), (107, near.replace("a1", "A1"), "en", "src0", 1),
    ]
    df = spark.createDataFrame(rows, DOC)
    if extra:
        from pyspark.sql import functions as F

        for field in EXTRA.split(", "):
            name, kind = field.split()
            df = df.withColumn(name, F.lit("7").cast(kind))
    return df


def empty(spark):
    return spark.createDataFrame([], DOC)


def labels(spark, df=None):
    """Junk (symbols between words) is 0, prose is 1."""
    return spark.createDataFrame([(k, k % 3 != 0, 0) for k in range(60)], "doc_id long, q boolean, toxic int").selectExpr("doc_id", "cast(q as int) quality", "toxic")


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
