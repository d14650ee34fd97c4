import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
from fixtures import SCHEMA, WORD, clashing, edge_rows

from contrastkit.llm import filters
from contrastkit.llm.filters import distinct_words, filter_audit, text_signals, word_hashes

LABELS = "doc_id long, quality int, toxic int, part string"


def brute(rows, labels):
    """By applying the filters to every row, order by order."""
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    first = {}
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    failed = []
    for d, t, _, source, _ in rows:
        t = t or ""
        words = WORD.findall(t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first[t]}
        failed.append((source or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out, removed_by = {}, Counter()
    for order in permutations("ABCDE"):
        for part in {f[0] for f in failed}:
            left = [f for f in failed if f[0] == part]
            for step, k in enumerate(order, 1):
                gone, stay = [f for f in left if k in f[1]], [f for f in left if k not in f[1]]
                of_part = [f for f in failed if f[0] == part and k in f[1]]
                out[part, "".join(order), step] = [len(stay), len(gone), len(of_part) - len(gone), sum(f[1] == {k} for f in of_part), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                removed_by[part, k] += len(gone)
                left = stay
    return {key: (*v, removed_by[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def given(frame):
    got = frame.collect()
    out = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in got}
    assert len(out) == len(got)
    return out


def test_edges(spark):
    rows = edge_rows()
    labels = [(0, 1, 0), (0, 0, 1), (1, 1, None), (3, None, 1), (None, 1, 1), (-5, 1, 1), (17, 0, 0), (18, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame([(*x, "x") for x in labels], LABELS)
    assert given(filter_audit(clashing(spark), frame)) == brute(rows, labels)
    assert filter_audit(spark.createDataFrame([], SCHEMA), frame).count() == 0
    assert given(filter_audit(clashing(spark), spark.createDataFrame([], LABELS))) == brute(rows, [])


def test_copies_with_one_id_and_many_sources(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(k // 2, text, "en", f"s{k % 3}" if k % 3 else None, 1) for k in range(40)] + [(7, text + " $", "en", "", 1)] * 3
    frame = spark.createDataFrame(rows, SCHEMA)
    assert given(filter_audit(frame, spark.createDataFrame([(3, 1, 1, "")], LABELS))) == brute(rows, [(3, 1, 1)])


def test_signals_are_those_of_the_words(spark):
    rows = {(r["n_words"], r["n_distinct"], r["n_capitals"], r["n_chars"]) for r in text_signals(clashing(spark)).collect()}
    assert rows == {(len(w), len(set(w)), len(re.findall("[A-Z]", t)), len(t)) for t in (r[1] or "" for r in edge_rows()) for w in [WORD.findall(t)]}


def spans(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    return data, filters.word_spans(data, offsets)


def test_colliding_words_are_told_apart(monkeypatch):
    long = "y" * 100
    texts = ["a b a c", "d d d", "", f"{long}p {long}q {long}p abcdefgh abcdefgi abcdefghi", "e"]
    wanted = [len(set(t.split())) for t in texts]
    data, (start, end, row) = spans(texts)
    assert distinct_words(data, start, end, row, len(texts)).tolist() == wanted
    monkeypatch.setattr(filters, "word_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    assert distinct_words(data, start, end, row, len(texts)).tolist() == wanted


def test_hashes_tell_words_apart_wherever_they_stand():
    draw = np.random.default_rng(2)
    words = ["".join(chr(97 + c) for c in draw.integers(0, 3, draw.integers(1, 90))) for _ in range(3000)]
    data, (start, end, _) = spans([" ".join(words)])
    by_word = defaultdict(set)
    for w, h in zip(words, word_hashes(data, start, end).tolist()):
        by_word[w].add(h)
    assert all(len(h) == 1 for h in by_word.values()) and len({min(h) for h in by_word.values()}) == len(by_word)
