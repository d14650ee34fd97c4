import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from fixtures import SCHEMA, clashing, edge_rows
from tokenizers import Tokenizer

from contrastkit.llm import queries
from contrastkit.llm.bpe import token_ids
from contrastkit.llm.packing import Capacity, _Classes, best_fit_packing, packed_pieces, plan_bins

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [0]


def check_pieces(rows, got, most):
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append((r["start"], r["piece"], r["length"], r["ids_crc32"]))
    wanted = defaultdict(list)
    for d, text, *_ in rows:
        ids = ids_of(text)
        first = len(ids) % most or most
        edges = [0, *range(first, len(ids) + 1, most)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            wanted[d].append((a, k, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert {d: sorted(v) for d, v in by_doc.items()} == {d: sorted(v) for d, v in wanted.items()}


def check_bins(got, capacity):
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(x for _, x in own[:k]) for k in range(len(own))]
        assert sum(x for _, x in own) <= capacity.tokens and len(own) <= capacity.documents
        assert sum(x * x for _, x in own) <= capacity.attention
    return len(bins)


def test_edges(spark):
    for docs in (clashing(spark),):
        got = best_fit_packing(docs, PATH, Capacity(tokens=512)).collect()
        check_pieces(edge_rows(), got, 512)
        check_bins(got, Capacity(tokens=512))
    assert best_fit_packing(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = best_fit_packing(docs, PATH).collect()
    check_pieces([tuple(r) for r in docs.select("doc_id", "text").collect()], got, 2048)
    assert check_bins(got, Capacity()) <= np.ceil(sum(r["length"] for r in got) / 2048) * 1.02 + 1


def test_every_capacity_holds(spark):
    draw = random.Random(1)
    rows = [(k, k, 0, draw.randint(1, 100)) for k in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, row long, piece int, length long")
    for score in ("norm", "dot"):
        capacity = Capacity(tokens=256, documents=5, attention=20000, weights=(1.0, 0.5, 0.5), score=score)
        got = packed_pieces(pieces, capacity).collect()
        assert len(got) == 3000
        used = check_bins(got, capacity)
        least = max(sum(r[3] for r in rows) / 256, 3000 / 5, sum(r[3] ** 2 for r in rows) / 20000)
        assert used <= 1.15 * least


def test_best_fit_decreasing():
    """The plan for classes of lengths opens as many bins as best fit piece by piece does."""
    draw = random.Random(5)
    for _ in range(20):
        lengths = [draw.randint(1, 60) for _ in range(300)]
        counts = {x: lengths.count(x) for x in set(lengths)}
        bins = []
        for x in sorted(lengths, reverse=True):
            fit = [k for k, r in enumerate(bins) if r >= x]
            if fit:
                bins[min(fit, key=lambda k: bins[k])] -= x
            else:
                bins.append(100 - x)
        plan = plan_bins(counts, Capacity(tokens=100))
        assert max(first + number for _, _, number, first, _ in plan) == len(bins)


def test_ids_are_those_of_the_library():
    samples = [t for _, t, *_ in edge_rows() if t] + ["I've  got\n\n 'x' \x1c\x1d \x85 \xa0  12½ \t", "word " * 400000, "a" * 5000, " " * 3000 + "b"]
    for text in samples:
        assert token_ids(PATH, text).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_all_residuals_choose(score):
    """Bins with the same room for tokens are told apart by what is left of documents and attention."""
    tight = Capacity(tokens=100, documents=4, attention=8000, weights=(1.0, 1.0, 1.0), score=score)
    plain = Capacity(tokens=100, documents=4, attention=8000, weights=(1.0, 0.0, 0.0), score=score)
    for capacity in (tight, plain):
        classes = _Classes(capacity)
        classes.put(40, 2, 6000, 0, 1)
        classes.put(40, 3, 4000, 1, 1)
        classes.put(40, 3, 6000, 2, 1)
        tokens, k = classes.best(30)
        found = classes.take(tokens, k)[:2]
        costs = {}
        for documents, attention in ((2, 6000), (3, 4000), (3, 6000)):
            residual, demand, caps = (40, documents, attention), (30, 1, 900), (100, 4, 8000)
            costs[documents, attention] = sum(w * ((r - d) / m) ** 2 for w, r, d, m in zip(capacity.weights, residual, demand, caps)) if score == "norm" else -sum(w * r * d / m / m for w, r, d, m in zip(capacity.weights, residual, demand, caps))
        assert costs[found] == min(costs.values())
        if capacity is tight:
            assert len(set(costs.values())) == 3


def test_documents_of_one_table_need_few_sequences(spark, sf_dir):
    got = queries.op3_best_fit_packing(spark, sf_dir)
    sums = got.selectExpr("count(distinct sequence_id) as n", "sum(length) as t").first()
    assert sums["n"] <= math.ceil(sums["t"] / 2048) + 1
    full = got.where("length = 2048")
    assert full.select("sequence_id").distinct().count() == full.count() > 0
