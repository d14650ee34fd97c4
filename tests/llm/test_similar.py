import random
from collections import defaultdict

from fixtures import SCHEMA, WORD, lowered

import corpus_pipeline


def shingles(text, size=5):
    words = WORD.findall(lowered(text))
    return {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} or {" ".join(words)}


def near_rows():
    """Texts and copies of them with one to twelve words changed, on both sides of similarity 0.8."""
    draw = random.Random(21)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(40):
        own = [word() for _ in range(200)]
        texts.append(own)
        for changed in (1, 2, 3, 4, 5, 8, 12):
            copy = list(own)
            for place in draw.sample(range(200), changed):
                copy[place] = word()
            texts.append(copy)
    return [(k, " ".join(t), "en", "src", 1) for k, t in enumerate(texts)]


def first_of_groups(rows, least):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= least * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for k, (d, *_) in enumerate(rows):
        groups[root(k)].append(d)
    return sorted(min(g) for g in groups.values())


def test_stage_drops_every_copy_of_similarity_four_fifths(spark, sf_dir):
    rows = near_rows()
    wanted = first_of_groups(rows, 0.8)
    assert 40 < len(wanted) < len(rows)
    got = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, SCHEMA), sf_dir)
    assert sorted(r["doc_id"] for r in got.collect()) == wanted


def test_a_large_group_of_near_copies(spark, sf_dir, monkeypatch):
    """Copies of a text that is not there, a few words apart: most pairs fall just short, and all are retrieved."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    base, rows = [word() for _ in range(60)], []
    for k in range(260):
        own = list(base)
        for place in draw.sample(range(60), draw.choice([1, 1, 2])):
            own[place] = word()
        rows.append((k, " ".join(own), "en", "src", 1))
    wanted = first_of_groups(rows, 0.8)
    assert 1 < len(wanted) < 200
    got = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, SCHEMA), sf_dir)
    assert sorted(r["doc_id"] for r in got.collect()) == wanted
