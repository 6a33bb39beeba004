"""Small tables with every awkward case: null columns, empty, blank and long texts,
repeated rows and texts, near copies, and extra columns whose names clash with
the operators' own."""

import random
import re

from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def rows(seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = ["alpha", "beta", "the", "of", "é", "straße", "x1", "Ñandú", "tion", "A", "中文", "q"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    out = []
    for i in range(n):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))]
        if i % 4 == 0:
            parts.append(passage)
        if i % 7 == 0:
            parts.append('token = "9765fab7324201a5ddfac0becd9064abbef40be8"')
        rng.shuffle(parts)
        out.append((i * 3, rng.choice([" ", "\n", "\t "]).join(parts), rng.choice(["en", "de", None]),
                    rng.choice(["s0", "s1", "s2", None]), None if i % 9 == 0 else 10))
    base = out[5][1]
    out += [(1000 + i, base, "en", "s0", 5) for i in range(6)]                          # exact copies
    out += [(1100 + i, base + " more" * i, "en", "s1", 5) for i in range(3)]            # near copies
    out += [(1200, "", "en", "s0", 0), (1201, None, None, None, None), (1202, " \t\n", "en", "s0", 3)]
    out += [(1300, "z" * 3000, "en", "s0", 1), (1301, "ab " * 2000, "en", "s2", 1), (1302, passage * 20, "fr", "s0", 1)]
    out += [(None, base, "en", "s1", 1), (None, "only here", None, "s0", 1)]            # null ids
    out += [out[8], out[8]]                                                             # repeated rows
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, seed=0, n=60):
    """With extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows(seed, n), SCHEMA).repartition(4)
    for name in ("_id", "__id", "__sha", "tag", "fp", "score", "size", "ids", "part", "body", "copies", "keep_id"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(i):
    return -(1 << 63) if i is None else i
