"""Small documents with everything that may go wrong, and the ways to read them back."""

import random

import public_tokenizers
from tokenizers import Tokenizer

#: Extra columns with names that the operators use inside.
EXTRA = ["k", "t", "row", "id", "part", "size", "hash", "key", "rest", "c0", "_part", "shard", "length", "word", "block", "kind", "tag", "score"]
SYLLABLES = ["the ", "an", "er", "ing ", "tion ", "re", "sh ", "ou", "is ", "of "]


def words(r, n):
    return "".join(r.choice(SYLLABLES) for _ in range(n)).strip()


def documents(seed=0, n=40):
    r = random.Random(seed)
    passage = words(r, 150)
    rows = [(i, words(r, r.randint(1, 200)), r.choice(["en", "fr", None]), f"src{i % 3}") for i in range(n)]
    rows += [(n, None, "en", None), (n + 1, "", "fr", "src0"), (n + 2, " \n\t ", None, "src0"), (n + 3, "...", "en", "src1"), (None, words(r, 30), "en", "src1")]
    rows += [rows[3], rows[3], (n + 4, rows[3][1], "en", "src2")]  # repeated rows and a copy
    rows += [(n + 5 + i, words(r, 20 * i) + " " + passage + " " + words(r, 30), "en", "src0") for i in range(4)]
    text = words(r, 400)
    rows += [(n + 10, text, "en", "src0"), (n + 11, text.replace("ing ", "ed ", 3), "en", "src0")]
    rows += [(n + 12, words(r, 60000), "en", "src0"), (n + 13, "Und " * 3000, "de", "src0"), (n + 14, "é中́\U0001f600 ﬁ x " * 80, None, "src1"), (n + 15, "a" * 3000, None, "src1")]
    return rows


def frame(spark, rows, extra=True):
    data = [(*x, None if x[1] is None else len(x[1])) + tuple(f"x{i}" for i in range(len(EXTRA) if extra else 0)) for x in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in EXTRA if extra)
    return spark.createDataFrame(data, schema).repartition(4)


def saved(spark, rows, path, benchmark=(), extra=True):
    """A data folder."""
    frame(spark, rows, extra).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


def ordered(rows):
    return sorted(rows, key=str)
