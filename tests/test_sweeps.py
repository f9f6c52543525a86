"""The near-copy join with pivots and the contradiction pass, against brute force and at growing sizes."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import contradiction, lifecycle, similarity

VECTORS = "id long, embedding array<double>, of string"


def copies(n=400, dims=12, seed=8):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (25, dims))
    x = middle[rng.integers(0, 25, n)] + rng.normal(0, 1, (n, dims)) * rng.choice([0.02, 0.1, 0.4], (n, 1))
    x[10:90] = x[3]
    return x


@pytest.mark.parametrize("least", [0.97, 0.75, 0.0])
@pytest.mark.parametrize(("tile", "pivots"), [(2000, None), (15, 7), (2000, 1)])
def test_pairs_equal_brute_force(spark, least, tile, pivots):
    x = copies()
    rows = [(k, v.tolist(), None if k % 2 else "g") for k, v in enumerate(x)] + [(900, None, "g"), (901, [0.0] * 12, "g"), (902, [1.0, 2.0], "g"), (903, [2.0, 4.0], "g")]
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T
    want = {(a, b) for a in range(400) for b in range(a + 1, 400) if a % 2 == b % 2 and near[a, b] >= least} | {(902, 903)}
    if pivots is None:
        got = similarity.vector_pairs(table, ["of"], least, tile).collect()
        assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
    members, links = similarity.near_links(table, ["of"], least, tile, pivots)
    first = {r["id"]: r["representative"] for r in members.collect()}
    assert sorted(first) == [*range(400), 902, 903]
    assert all(first[k] == (3 if k % 2 else 10) for k in range(10, 90))
    got = links.collect()
    assert {(r.a, r.b) for r in got} == {(a, b) for a, b in want if first[a] == a and first[b] == b} and len(got) == len({(r.a, r.b) for r in got})


def test_bounds_leave_out_most_pairs(spark):
    x = copies(3000, 8, 1)
    table = spark.createDataFrame([(k, v.tolist(), "g") for k, v in enumerate(x)], VECTORS)
    few, all_ = similarity.compared(table, ["of"], 0.97)
    assert all_ == 2920 * 2919 // 2 and few < all_ / 4
    assert similarity.compared(table, ["of"], 0.97, 500)[0] < all_ / 20 and similarity.compared(table, ["of"], 0.75, 100)[0] < all_ / 2
    assert similarity.compared(table.limit(0), ["of"], 0.97) == (0, 0)


# ---- contradictions

FIELDS = "id long, content string, type string, source_kind string, observed_at timestamp_ntz, confidence double, valid_from timestamp_ntz, valid_until timestamp_ntz, project_id string, user_id string"
START = datetime(2024, 1, 1)


def said(n, seed, span, values=3, closed=0.4):
    """Statements of few templates with many ties of time, confidence and authority."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in rng.permutation(n):
        at = START + timedelta(days=int(rng.integers(0, span)))
        begins = at - timedelta(days=int(rng.integers(0, 3)))
        ends = begins + timedelta(days=int(rng.integers(1, 6))) if rng.random() < closed else None
        kind = ["semantic", "decision", "procedural"][rng.integers(0, 3)]
        rows.append((int(k), f"Node  {rng.integers(0, values)}.1", kind, ["explicit", "tool", "tool"][rng.integers(0, 3)], at, float(rng.integers(0, 3)) / 2, begins, ends, ["p", None][rng.integers(0, 2)], None))
    return rows


def by_pairs(rows):
    """All pairs in order of their later time and ids; a pair with a closed side is passed over."""
    pairs = []
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[8:] == b[8:] and a[1] != b[1] and (b[7] is None or a[6] < b[7]) and (a[7] is None or b[6] < a[7]):
                pairs.append((max(a[4], b[4]), a[0], b[0], a, b))
    gone = {}
    for _, i, j, a, b in sorted(pairs, key=lambda p: p[:3]):
        if i in gone or j in gone:
            continue
        keys = [((a[3] == "explicit"), (b[3] == "explicit")), (a[2] == "decision", b[2] == "decision"), (a[4], b[4]), (a[5], b[5])]
        won = next((x > y for x, y in keys if x != y), None)
        if won is None:
            gone[i] = gone[j] = ("disputed", None, None)
        else:
            winner, loser = (a, b) if won else (b, a)
            gone[loser[0]] = ("superseded", winner[0], max(winner[4], loser[6]))
    return gone


@pytest.mark.parametrize(("seed", "span", "values", "closed"), [(1, 40, 3, 0.4), (2, 3, 4, 0.4), (3, 200, 2, 0.0), (4, 1, 3, 0.9), (5, 60, 12, 1.0)])
def test_the_pass_equals_all_pairs_in_order(spark, monkeypatch, seed, span, values, closed):
    rows = said(180, seed, span, values, closed)
    got = contradiction.settled(spark.createDataFrame(rows, FIELDS).repartition(3)).collect()
    want = by_pairs(rows)
    assert len(got) == len(want) and {r["id"]: (r["outcome"], r["winner"], r["valid_until"]) for r in got} == want


def test_small_blocks_find_the_same(monkeypatch):
    monkeypatch.setattr(contradiction.Live, "SIZE", 4)
    rng, live, kept = np.random.default_rng(0), contradiction.Live(), {}
    for step in range(600):
        if kept and rng.random() < 0.4:
            key = int(rng.choice(list(kept)))
            del kept[key]
            live.remove(key)
        key = int(rng.integers(0, 10_000))
        if key not in kept:
            start = int(rng.integers(0, 100))
            kept[key] = (int(rng.integers(0, 3)), start, start + int(rng.integers(1, 40)))
            live.add(key, *kept[key])
        value, start, after = int(rng.integers(0, 3)), int(rng.integers(0, 100)), int(rng.integers(-5, 10_000))
        want = [k for k, (v, s, e) in kept.items() if k > after and v != value and s < start + 20 and e > start]
        assert live.next(value, start, start + 20, after) == min(want, default=None)


def test_statements_without_rivals(spark):
    rows = said(50, 1, 10, values=1)
    assert contradiction.settled(spark.createDataFrame(rows, FIELDS)).count() == 0
    odd = [(1, None, "semantic", "tool", START, 0.5, START, None, "p", None), (2, "no numbers", "semantic", "tool", START, 0.5, START, None, "p", None)]
    assert contradiction.settled(spark.createDataFrame(odd, FIELDS)).count() == 0
    assert contradiction.settled(spark.createDataFrame([], FIELDS)).count() == 0


def test_a_hot_template_takes_linear_time():
    def seconds(n, values):
        rng = np.random.default_rng(0)
        rows = [{"id": int(k), "numbers": [str(v)], "explicit": False, "decision": bool(v == 1), "at": t, "confidence": 0.5, "start": t, "end": contradiction.EVER} for t, (k, v) in enumerate(zip(rng.permutation(n), rng.integers(0, values, n)))]
        state, began = contradiction.Pass(), time.time()
        closed = sum(len(state.arrive([r])) for r in rows)
        return time.time() - began, closed

    for values in (2, 40):
        small, _ = seconds(5_000, values)
        large, closed = seconds(50_000, values)
        assert closed > 1_000 and large < 25 * max(small, 0.2)


def test_pairs_of_a_template_are_still_listed(spark):
    rows = said(40, 7, 10)
    pairs = lifecycle.contradictions(spark.createDataFrame(rows, FIELDS)).select(F.col("id_a"), F.col("id_b")).collect()
    assert pairs and all(a < b for a, b in pairs)
