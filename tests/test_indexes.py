"""The vector index and the postings against scans."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import numpy as np
import pytest

from lodestone.operators import memory, postings, vector_index

VECTORS = "id long, embedding array<float>, cell string"


def clustered(n=1200, dims=16, centres=30, seed=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (centres, dims))
    x = (middle[rng.integers(0, centres, n)] + rng.normal(0, 0.15, (n, dims))).astype(np.float32)
    x[50:350] = x[0]  # a cell that a quarter of the rows share
    return x


def partition_filters(df):
    """The filters by which a plan leaves out folders."""
    return re.search(r"PartitionFilters: \[([^\]]*)\]", df._jdf.queryExecution().toString())[1]


def brute(x, ids, asked, k):
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = np.round(unit[asked] @ unit.T, 9)
    out = set()
    for q, line in zip(asked, near, strict=True):
        out |= {(int(ids[q]), int(ids[j]), n + 1) for n, j in enumerate(np.lexsort((ids, -line))[:k])}
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(k, [float(v) for v in x], "c") for k, x in enumerate(clustered())]
    return spark.createDataFrame([*rows, (5000, None, "c"), (5001, [0.0] * 16, "c"), (5002, [1.0, 2.0], "c"), (5003, [float("nan")] * 16, "c")], VECTORS).repartition(4)


@pytest.fixture(scope="module")
def index(vectors):
    return vector_index.build(vectors, cells=40, block=100)


def test_exact_search_equals_brute_force(vectors, index):
    x = clustered()
    asked = list(range(0, 1200, 40))
    got = vector_index.nearest(index, vectors.where("id % 40 = 0"), 20, probes=2, exact=True).collect()
    assert {(r["query"], r["id"], r["vector_rank"]) for r in got} == brute(x, np.arange(1200), asked, 20)


def test_few_cells_find_nine_of_ten(vectors, index):
    x = clustered()
    asked = list(range(0, 1200, 40))
    true = {(q, i) for q, i, _ in brute(x, np.arange(1200), asked, 20)}
    got = {(r["query"], r["id"]) for r in vector_index.nearest(index, vectors.where("id % 40 = 0"), 20, probes=6).collect()}
    assert len(true & got) >= 0.9 * len(true)
    assert vector_index.probes_for(index, vectors, 20, 0.95) <= 20


def test_a_hot_cell_is_many_blocks_and_all_rows_are_stored(index):
    blocks = index.blocks().collect()
    assert max(b["n"] for b in blocks) <= 100
    assert sorted(i for b in blocks for i in b["ids"]) == list(range(1200))
    assert max(sum(b["cell"] == c for b in blocks) for c in range(40)) >= 3


def test_only_the_folders_of_some_cells_are_read(index):
    assert "cell" in partition_filters(index.blocks([1, 2]))
    assert {r["cell"] for r in index.blocks([1, 2]).collect()} <= {1, 2}


def test_tables_without_vectors(spark, vectors, index):
    empty = vector_index.build(spark.createDataFrame([(1, None, "")], VECTORS))
    assert vector_index.nearest(empty, vectors).count() == 0
    assert vector_index.nearest(index, spark.createDataFrame([(1, None, ""), (2, [1.0], "")], VECTORS)).count() == 0


# ---- postings

MEMORIES = "id long, content string, observed_at timestamp_ntz, status string"


@pytest.fixture(scope="module")
def memories(spark):
    rng = np.random.default_rng(2)
    start = datetime(2024, 1, 1)
    weights = 1.0 / np.arange(1, 41)
    words = [*(f"w{k}" for k in range(38)), "v1.2", "naïve"]
    rows = []
    for k in range(900):
        text = " ".join(rng.choice(words, rng.integers(1, 60), p=weights / weights.sum()))
        rows.append((k, text + "!", start + timedelta(hours=int(rng.integers(0, 50))), "active" if k % 3 else "archived"))
    rows += [(2000, None, start, "active"), (2001, "", start, "active"), (2002, "w3 " * 40_000, start, "active")]
    return spark.createDataFrame(rows, MEMORIES).repartition(4)


@pytest.fixture(scope="module")
def stored(memories):
    return postings.build(memories, segment=64)


@pytest.mark.parametrize("terms", [["w0"], ["w37", "w36"], ["w0", "w1", "w2", "w3"], ["w5.w6", "w1 w30"], ["v1.2"], ["nothing"], [], ["?!"], ["W3"], ["na ve", "w20"]])
@pytest.mark.parametrize("limit", [5, 50, 5000])
def test_postings_equal_the_scan(memories, stored, terms, limit):
    allowed = memories.where("status = 'active'")
    rows = lambda df: sorted((r["lexical_rank"], r["id"], r["ts_rank"]) for r in df.select("lexical_rank", "id", "ts_rank").collect())
    assert rows(postings.lexical(stored, allowed, terms, limit)) == rows(memory.lexical(allowed, terms, limit))


def test_a_search_stops_above_the_lowest_layer(memories, stored, monkeypatch):
    read, scored = [], postings.scored
    monkeypatch.setattr(postings, "scored", lambda index, parts, tokens, layer: read.append(layer) or scored(index, parts, tokens, layer))
    postings.lexical(stored, memories, ["w0"], 5, first=2).count()
    assert read and min(read) > 0
    assert stored.layers(["w0"])["w0", 0][0] > 0


def test_only_the_folders_of_the_terms_are_read(stored):
    assert "folder" in partition_filters(stored.of(["w0"]))
    assert "content" not in stored.of(["w0"]).columns
    assert max(len(r["ids"]) for r in stored.of(["w0"]).collect()) < 900
