"""Documents with every edge case, and plain-Python rules that tests hold results against."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def edge_rows(seed=7):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 6))) for _ in range(300)]
    some = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    passage, line = some(60), some(8)
    texts = [some(80) + "\n" + line + "\n" + some(40) for _ in range(12)]
    texts += [some(20) + " " + passage + " " + some(20), passage, some(30) + "\t\n " + passage]
    texts += [texts[0], texts[0], texts[1].upper(), texts[2] + " more"]
    texts += [None, "", " \n\t\x0b ", "\n\n", "*** $$$ %%%", "12 34", "É ß ñ ü", "a", line, "𝒳 <|endoftext|> 漢字 ¿　?", "x " * 3000, some(9000)]
    rows = [(k, t, ["en", "de", None][k % 3], ["src1", "Src2", None, "é"][k % 4], len(t) if t is not None else None) for k, t in enumerate(texts)]
    return rows + [rows[0], rows[0], (None, texts[3], "en", "src1", 1), (None, None, None, None, None), (-5, texts[4], "de", "src1", 0)]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def clashing(spark):
    """The edge documents with extra columns by names that operators use within."""
    from pyspark.sql import functions as F

    names = ["key", "d", "n", "row", "piece", "size", "part", "words", "lines", "fp", "rank", "kept", "tree", "score", "held_out", "stratum", "lost"]
    return edge_docs(spark).select("*", *[F.lit("x").alias(n) for n in names])
