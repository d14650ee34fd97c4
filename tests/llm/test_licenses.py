import random
import re

import pytest
from fixtures import SCHEMA, clashing, edge_rows

from contrastkit.llm import licenses


def shingles(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


def expected(rows):
    out = []
    for d, text, *_ in rows:
        own = shingles(text)
        for k, (name, template) in enumerate(licenses.TEMPLATES):
            wanted = shingles(template)
            if wanted and len(own & wanted) >= licenses.LEAST * len(wanted):
                out.append((d, k, name, len(own & wanted)))
    return out


def planted():
    draw = random.Random(4)
    rows = []
    for k, (_, template) in enumerate(licenses.TEMPLATES * 4):
        words = template.split()
        if k >= len(licenses.TEMPLATES) * 2 and len(words) > 60:
            words[draw.randrange(len(words))] = "changed"
        filler = lambda n: " ".join("w" + str(draw.randrange(500)) for _ in range(n))
        rows.append((1000 + k, f"{filler(draw.randrange(60))}\n{' '.join(words).upper() if k % 2 else '  '.join(words)} {filler(draw.randrange(200))}", "en", "s", 1))
    return rows


def test_edges_and_planted(spark):
    rows = edge_rows() + planted()
    got = [tuple(r)[:4] for r in licenses.license_scan(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=repr) == sorted(expected(rows), key=repr) and len(got) >= 40
    assert licenses.license_scan(clashing(spark)).count() == len(expected(edge_rows()))
    assert licenses.license_scan(spark.createDataFrame([], SCHEMA)).count() == 0
    assert licenses.license_scan(clashing(spark), templates=(("short", "two words"),)).count() == 0
    with pytest.raises(ValueError):
        licenses.license_scan(clashing(spark), templates=(("x", "a b c d e f"),) * 501)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(tuple(r)[:4] for r in licenses.license_scan(docs).collect()) == sorted(expected(rows))


def test_edited_templates_are_retrieved(spark):
    """Every template of a few shingles or more, with as many words changed as containment allows, is found."""
    draw, rows = random.Random(12), []
    for _, template in licenses.TEMPLATES:
        plain = [w for w in re.split(r"[\W_]+", template.lower()) if w]
        if len(plain) < 11:
            continue
        for k in range(40):
            words = list(plain)
            for _ in range(draw.choice([0, 1, 1, 2, 3])):
                words[draw.choice([0, len(words) - 1, draw.randrange(len(words))])] = f"changed{draw.randrange(99)}"
            filler = " ".join(f"w{draw.randrange(900)}" for _ in range(draw.randrange(90)))
            rows.append((len(rows), f"{filler} {' '.join(words)} {filler}", "en", "s", 1))
    wanted = expected(rows)
    assert len(wanted) > 150
    got = [tuple(r)[:4] for r in licenses.license_scan(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == sorted(wanted)
