"""Token-budget packing of ranked results, one fold a query."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def estimate(text: str | None) -> int:
    """A quarter of the UTF-16 length, rounded up."""
    return -(-len((text or "").encode("utf-16-le")) // 8)


def pack(items: list[dict], budget: int, heads: int = 50, overflow: int = 10) -> tuple[list[dict], int]:
    """Summaries by score for a token, then whole contents by rank, then bare titles for what is left.

    ``items`` are in rank order with id, title, summary, content and score. Returns the packed ones in rank
    order with kind and tokens, and the tokens used, which never pass the budget.
    """
    budget, used, kinds = max(0, budget), 0, {}
    size = {(x["id"], k): estimate(x[k]) for x in items for k in ("title", "summary", "content")}
    head = items[:heads]
    dense = sorted(range(len(head)), key=lambda k: (-head[k]["score"] / max(1, size[head[k]["id"], "summary"]), k))
    for k in dense:
        cost = size[head[k]["id"], "summary"]
        if 0 < cost <= budget - used:
            kinds[head[k]["id"]] = ("summary", cost)
            used += cost
    for x in head:
        have, want = size[x["id"], "summary"], size[x["id"], "content"]
        if x["id"] in kinds and x["content"] != x["summary"] and want > have and want - have <= budget - used:
            kinds[x["id"]] = ("content", want)
            used += want - have
    titles = 0
    for x in items:
        cost = size[x["id"], "title"]
        if x["id"] not in kinds and titles < overflow and 0 < cost <= budget - used:
            kinds[x["id"]] = ("title-only", cost)
            used, titles = used + cost, titles + 1
    return [x | {"kind": kinds[x["id"]][0], "tokens": kinds[x["id"]][1]} for x in items if x["id"] in kinds], used


def packed(ranked: DataFrame, budget: int, heads: int = 50, overflow: int = 10) -> DataFrame:
    """Pack each query's ranked rows (query_id, rank, id, title, summary, content, score). A query's rows are
    its channels' capped candidates, so a group is small."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        out, _ = pack(g.sort_values("rank").to_dict("records"), budget, heads, overflow)
        return pd.DataFrame([(x["query_id"], x["id"], x["rank"], x["kind"], x["tokens"]) for x in out], columns=["query_id", "id", "rank", "kind", "tokens"])

    return ranked.groupBy("query_id").applyInPandas(fold, "query_id long, id long, rank int, kind string, tokens long")
