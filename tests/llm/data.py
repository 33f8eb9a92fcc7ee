"""Small tables that the corpus tests share."""

import random

from pyspark.sql import types as T

WORDS = "the and of erron ther thtion ofand restion whean sterre anhe tiored inthou edbleat lyonsh thaan eronnd".split()

#: Columns of documents and others whose names the operators use themselves.
MESSY = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("fp", "kept", "keep_id", "words", "row", "maybe", "score", "h1", "line", "hits", "body", "node", "doc_key", "grade", "window")]
)


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 10**6)) for _ in range(n))


def messy_rows():
    rng = random.Random(7)
    long_text = "\n".join(sentence(rng, 40) for _ in range(400))
    texts = [None, "", " \t\n", "one", "two words", long_text, long_text, "x" * 60_000, "a b" * 9000, sentence(rng, 50), "é😀 ñ İ K", "<|endoftext|> <|startoftext|>", "token = \"abcdef0123456789\"", "\n\n\n"]
    texts += [texts[9]] * 3
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, "null id", None, None, None), (None, None, None, None, None), (-5, texts[9] + " ", None, None, None)]
    return [(*r, *["x"] * 15) for r in rows]


def messy(spark):
    return spark.createDataFrame(messy_rows(), MESSY)


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
