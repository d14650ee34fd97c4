import numpy as np
import xxhash
from fixtures import SCHEMA, WORD, clashing, edge_rows, lowered

from contrastkit.llm.simhash import BKTree, near_duplicates


def fingerprint(text, size=3):
    words = WORD.findall(lowered(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], dtype=np.uint64)
    ones = [(hashes >> np.uint64(b) & np.uint64(1)).sum() for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * int(ones[b]) > len(shingles))


def expected(rows, radius):
    prints = np.array([fingerprint(t) for _, t, *_ in rows], dtype=np.uint64)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, own in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(prints ^ own) <= radius):
            a, b = root(k), root(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for k, (d, *_) in enumerate(rows):
        if d is not None:
            least[root(k)] = min(d, least.get(root(k), d))
    return [(d, f"{int(prints[k]):016x}", least.get(root(k))) for k, (d, *_) in enumerate(rows)]


def test_edges(spark):
    for docs in (clashing(spark),):
        got = [tuple(r) for r in near_duplicates(docs).collect()]
        assert sorted(got, key=repr) == sorted(expected(edge_rows(), 2), key=repr)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_documents_and_small_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, near_duplicates(docs, cap=8).collect())) == sorted(expected(rows, 2))


def test_tree_finds_what_a_scan_finds():
    draw = np.random.default_rng(3)
    items = [int(x) for x in draw.integers(0, 1 << 12, 400)]
    tree = BKTree()
    for x in items:
        tree.add(x)
    for q in items[:50]:
        assert sorted(tree.within(q, 2)) == [k for k, x in enumerate(items) if (x ^ q).bit_count() <= 2]
