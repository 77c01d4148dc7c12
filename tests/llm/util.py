"""Small tables with the awkward rows that every operator must stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words="the of and to in a is that it for was on are with as be at by this from le la les de et un une que der die und".split()):
    return " ".join(rng.choice(words) if rng.random() < 0.6 else "".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(n))


def documents(spark, n=60, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        text = prose(rng, rng.randrange(5, 120))
        rows.append((k, text, rng.choice(["en", "fr", "de"]), f"src{k % 3}", len(text)))
    copies = [(n + k, rows[0][1].replace(" ", "  ", k), "en", "hot", 1) for k in range(20)]
    near = [(2 * n + k, " ".join(w for j, w in enumerate(rows[1][1].split()) if j != 3 * k), "en", "hot", 1) for k in range(12)]
    odd = [(-1, None, None, None, None), (-2, "", "en", None, 0), (-3, " \t\n", None, "x", 3), (-4, "Ünïcode \U0001f600 \x0b\x0c", "fr", "x", 1), (-5, "ab " * 20000, "en", "x", 1), (None, "no id here at all", "en", "x", 1)]
    return spark.createDataFrame(rows + copies + near + odd, SCHEMA)


def clashing(df):
    """The same rows with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    names = "digest content row words keys bands rep shingle component label score vector data host path first __training_x salt kept".split()
    return df.select("*", *(F.lit("x").alias(c) for c in names))
