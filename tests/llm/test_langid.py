import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import SCHEMA, clashing, edge_rows

from contrastkit.llm import langid, queries
from contrastkit.llm.langid import _BLOCK, BUCKETS, Model, identify_languages, predict, train


def grams_of(text):
    """Hashed 1- to 3-grams of the letters of a text, blanks for all else, one by one."""
    wrap = (1 << 32) - 1
    low = lambda c: ord(c.lower()) if len(c.lower()) == 1 else ord(c)
    codes = [0] + [low(c) if c.isalpha() else 0 for c in text] + [0]
    a, b, c, d = 2654435761, 2246822519, 3266489917, 668265263
    bucket = lambda h: ((h ^ (h >> 15)) * b & wrap) >> (32 - BUCKETS.bit_length() + 1)
    out = []
    for i, x in enumerate(codes):
        one = x * a & wrap
        if x:
            out.append(bucket(one))
        if i + 1 < len(codes):
            two = one ^ (codes[i + 1] * b + d & wrap)
            if x or codes[i + 1]:
                out.append(bucket(two))
            if i + 2 < len(codes) and codes[i + 1]:
                out.append(bucket(two ^ (codes[i + 2] * c + b & wrap)))
    return out


def plain_bayes(rows):
    """(language, posterior) of each (doc_id, text, lang), learned from all labelled ones that are not held out."""
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    counts, docs = defaultdict(Counter), Counter()
    for d, text, lang in rows:
        if text is not None and lang is not None and not held(d):
            counts[lang].update(grams_of(text))
            docs[lang] += 1
    names, n = sorted(docs), sum(docs.values())
    total = {x: sum(counts[x].values()) + 0.5 * BUCKETS for x in names}
    out = []
    for d, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            out.append((d, held(d), "und", 0.0))
            continue
        own = Counter(grams_of(text))
        logs = [math.log((docs[x] + 1) / (n + len(names))) + sum(k * math.log((counts[x][g] + 0.5) / total[x]) for g, k in own.items()) for x in names]
        best = max(logs)
        out.append((d, held(d), names[logs.index(best)], 1 / sum(math.exp(v - best) for v in logs)))
    return out


def test_query_gives_what_plain_bayes_does(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    wanted = {r[0]: r[1:] for r in plain_bayes(rows)}  # the table has fewer documents of a language than the sample's bound
    got = queries.op10_language_id(spark, sf_dir).collect()
    assert len(got) == len(wanted)
    for r in got:
        held, lang, score = wanted[r["doc_id"]]
        assert (r["held_out"], r["lang_pred"]) == (held, lang) and r["score"] == pytest.approx(score, abs=1e-9)


def test_parts_do_not_change_predictions(spark, monkeypatch):
    draw = np.random.default_rng(3)
    rows = [(k, " ".join("".join(chr(97 + (k % 7) * 2 + x) for x in draw.integers(0, 9, 6)) for _ in range(12)), f"l{k % 7}", "s", 1) for k in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(tuple, identify_languages(docs).select("doc_id", "lang_pred", "score").collect()))
    monkeypatch.setattr(langid, "TOGETHER", 2)
    parts = sorted(map(tuple, identify_languages(docs).select("doc_id", "lang_pred", "score").collect()))
    assert [r[:2] for r in parts] == [r[:2] for r in whole] and np.allclose([r[2] for r in parts], [r[2] for r in whole])
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    with pytest.raises(ValueError):
        identify_languages(docs)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = identify_languages(docs).select("doc_id", "held_out", "lang_pred", "score").collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) >= 0.97


def test_inputs_are_the_text_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs)
    one = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict(docs, model).collect()}
    other = predict(docs.selectExpr("doc_id + 1000000 as doc_id", "text", "'xx' as lang", "null as source"), model).collect()
    assert all(one[r["doc_id"] - 1000000] == (r["lang_pred"], r["score"]) for r in other)


def test_edges(spark):
    for docs in (clashing(spark),):
        got = identify_languages(docs).collect()
        assert len(got) == len(edge_rows())
        for r in got:
            letters = any(c.isalpha() for c in r["text"] or "")
            assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0)
            assert r["lang_pred"] in ("en", "de", "und") and r["held_out"] is (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert identify_languages(spark.createDataFrame([], SCHEMA)).count() == 0
    unlabelled = identify_languages(spark.createDataFrame([(1, "words here", None, None, 1)], SCHEMA)).collect()
    assert [(r["lang_pred"], r["score"]) for r in unlabelled] == [("und", 0.0)]


def test_long_texts_score_as_their_parts_do():
    draw = np.random.default_rng(1)
    counts = draw.integers(1, 50, (2, 1 << 10)).astype(float)
    model = Model(["a", "b"], counts, np.array([3.0, 4.0]), 0.5)
    text = " ".join("".join(chr(97 + x) for x in draw.integers(0, 26, 5)) for _ in range(_BLOCK // 3))
    small = 1 << 10
    whole = model.predict([text, "abc"])
    before, langid._BLOCK = langid._BLOCK, small
    try:
        parts = model.predict([text, "abc"])
    finally:
        langid._BLOCK = before
    assert whole[0] == parts[0] and np.allclose(whole[1], parts[1])


def test_sample_is_bounded(spark):
    rows = [(k, "some text", "en", "s", 1) for k in range(5000)] + [(9000, "andere worte", "de", "s", 1)]
    model = train(spark.createDataFrame(rows, SCHEMA), per_language=100)
    assert sorted(model.languages) == ["de", "en"]
