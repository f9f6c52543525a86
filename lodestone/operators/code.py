"""Code memory: readable sources, symbol tables, drift applied, knowledge renewed, the architecture digest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .packing import estimate

# Languages by extension, kinds of symbols that are entry points, in order.
LANGUAGES = {"ts": "ts", "mts": "ts", "cts": "ts", "tsx": "tsx", "js": "js", "mjs": "js", "cjs": "js", "jsx": "js", "py": "py", "go": "go", "rs": "rs"}
ENTRY_KINDS = ("function", "class", "struct", "interface", "trait", "enum", "type", "module")


def source_text(content: Column, most_bytes: int = 1 << 20) -> Column:
    """A file's text (without a byte order mark) or why it has none: too_large, binary (a zero byte), not_utf8."""
    raw = F.hex(F.substring(content, 1, 8000))
    body = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, 4, 1 << 30)).otherwise(content)
    why = (F.when(F.octet_length(content) > most_bytes, "too_large").when(raw.rlike("^(?:..)*?00"), "binary")
           .when(~F.is_valid_utf8(F.decode(body, "ISO-8859-1")) | F.try_validate_utf8(body.cast("string")).isNull(), "not_utf8"))
    return F.struct(why.alias("skipped"), F.when(why.isNull(), body.cast("string")).alias("text"))


def language(path: Column) -> Column:
    """A path's language by its extension: the extension itself for others, 'other' without one."""
    end = F.lower(F.regexp_extract(path, r"^.+\.([^.]+)$", 1))
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.when(end == "", "other").otherwise(F.coalesce(F.try_element_at(table, end), end))


def language_mix(files: DataFrame, most: int = 5) -> DataFrame:
    """The languages with most paths of each repository and how many they have."""
    g = files.groupBy("repository", language(F.col("path")).alias("language")).agg(F.count_distinct("path").alias("files"))
    order = Window.partitionBy("repository").orderBy(F.col("files").desc(), "language")
    return g.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)


def symbol_tables(saved: DataFrame, extracted: DataFrame) -> DataFrame:
    """Files (path, hash) whose symbols are written again, added or dropped; those of equal hash stay as they are."""
    both = saved.select("path", F.col("hash").alias("old")).join(extracted.select("path", F.col("hash").alias("new")), "path", "full_outer")
    what = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "dropped").when(F.col("old") == F.col("new"), "unchanged").otherwise("rewritten")
    return both.select("path", what.alias("outcome"))


def snapshot_saved(saved: DataFrame, captured: DataFrame) -> DataFrame:
    """Fingerprints (path, blob) after a capture (path, blob, available): changed ones are updated, new ones added,
    missing ones deleted, and those that could not be read keep what they had."""
    both = saved.select("path", F.col("blob").alias("old")).join(captured.select("path", F.col("blob").alias("new"), "available"), "path", "full_outer")
    what = (F.when(F.col("available").isNull(), "deleted").when(~F.col("available"), "retained").when(F.col("old").isNull(), "added")
            .when(F.col("old") != F.col("new"), "updated").otherwise("unchanged"))
    return both.select("path", what.alias("outcome"), F.when(what == "retained", F.col("old")).when(what != "deleted", F.col("new")).alias("blob"))


def drift_applied(drifted: DataFrame, memories: DataFrame) -> DataFrame:
    """What drift does to each memory (id, state, to_path for each reference): references that moved are retargeted;
    a memory with any other drifted reference that is active becomes stale."""
    g = drifted.groupBy("id").agg(F.count_if(F.col("state") == "moved").alias("retargeted"), F.count_if(F.col("state").isin("content_changed", "path_missing")).alias("lost"))
    rows = g.join(memories.select("id", "status"), "id")
    return rows.select("id", "retargeted", F.when((F.col("lost") > 0) & (F.col("status") == "active"), "stale").otherwise(F.col("status")).alias("status"))


def renewed(stale: DataFrame, candidates: DataFrame) -> DataFrame:
    """What becomes of stale memories (id, type, content_hash, path) given what was extracted from their paths again
    (path, type, content_hash, content, importance, confidence): 'refreshed' if the same statement came out,
    'superseded' by the most important other of its type, or 'deferred'. Candidates are one row for each path and type
    (and statement) before they meet a memory; their texts go along only where a memory has several paths."""
    order = F.struct("importance", "confidence", "content")
    best = candidates.groupBy("path", "type").agg(F.max(order).alias("top"), F.max_by("content_hash", order).alias("new_hash"))
    out = candidates.select("path", "type", "content_hash").distinct().withColumn("same", F.lit(True))
    rows = stale.select("id", "path", "type", "content_hash").withColumn("several", F.count("*").over(Window.partitionBy("id")) > 1)
    rows = rows.join(out, ["path", "type", "content_hash"], "left").join(best, ["path", "type"], "left")
    top = F.struct("top.importance", "top.confidence", F.when(F.col("several"), F.col("top.content")).alias("content"))
    g = rows.groupBy("id").agg(F.max("same").alias("same"), F.max_by("new_hash", top).alias("best"))
    outcome = F.when(F.col("same"), "refreshed").when(F.col("best").isNotNull(), "superseded").otherwise("deferred")
    return g.select("id", outcome.alias("outcome"), F.when(outcome == "superseded", F.col("best")).alias("successor"))


def modules(files: DataFrame, symbols: DataFrame, entries: int = 3, kinds: int = 4) -> DataFrame:
    """Modules (a path's folder) of each repository: files, symbols, the first entry points by kind and name, and the
    most frequent kinds of symbols, as text."""
    folder = F.when(F.col("path").rlike("^.+/"), F.regexp_extract("path", "^(.+)/[^/]*$", 1)).otherwise("(root)").alias("module")
    paths = files.select("repository", "path").union(symbols.select("repository", "path")).groupBy("repository", folder).agg(F.count_distinct("path").alias("files"))
    named = symbols.select("repository", folder, "kind", "name")
    rank = F.array_position(F.array(*map(F.lit, ENTRY_KINDS)), F.col("kind"))
    first = named.where(rank > 0).groupBy("repository", "module", "name").agg(F.min(rank).alias("rank"))
    by = Window.partitionBy("repository", "module")
    first = first.withColumn("k", F.row_number().over(by.orderBy("rank", "name"))).where(F.col("k") <= entries)
    points = first.groupBy("repository", "module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), ", ").alias("entry_points"))
    mix = named.groupBy("repository", "module", "kind").agg(F.count("*").alias("n"))
    total = mix.groupBy("repository", "module").agg(F.sum("n").alias("symbols"))
    mix = mix.withColumn("k", F.row_number().over(by.orderBy(F.col("n").desc(), "kind"))).where(F.col("k") <= kinds)
    said = mix.groupBy("repository", "module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(" ", F.col("n").cast("string"), "kind").alias("t")))), lambda x: x["t"]), ", ").alias("kinds"))
    keys = ["repository", "module"]
    out = paths.join(total, keys, "left").join(points, keys, "left").join(said, keys, "left")
    return out.select(*keys, "files", F.coalesce("symbols", F.lit(0).cast("long")).alias("symbols"), F.coalesce("entry_points", F.lit("")).alias("entry_points"), F.coalesce("kinds", F.lit("no symbols")).alias("kinds"))


def architecture_digests(files: DataFrame, symbols: DataFrame, budget: int = 300) -> DataFrame:
    """A text of fewer than ``budget`` tokens for each repository: totals, languages, then its modules with most
    symbols as long as whole lines fit. Only as many modules as could fit are brought together."""
    found = modules(files, symbols)
    order = Window.partitionBy("repository").orderBy(F.col("symbols").desc(), F.col("files").desc(), "module")
    totals = found.groupBy("repository").agg(F.count("*").alias("modules"), F.sum("files").alias("files"), F.sum("symbols").alias("symbols"))
    languages = language_mix(files).groupBy("repository").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.concat_ws(" ", "language", F.col("files").cast("string")).alias("t")))), lambda x: x["t"]), ", ").alias("languages"))
    line = F.concat(F.lit("- "), "module", F.lit(": "), F.col("files").cast("string"), F.lit(" file(s), "), "kinds", F.when(F.col("entry_points") != "", F.concat(F.lit("; entry: "), "entry_points")).otherwise(""))
    lines = found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= budget).select("repository", "position", line.alias("line"))
    head = totals.join(languages, "repository").select("repository", F.concat(F.lit("code: "), F.col("modules").cast("string"), F.lit(" module(s), "), F.col("files").cast("string"), F.lit(" file(s), "), F.col("symbols").cast("string"), F.lit(" symbol(s)\nlanguages: "), "languages").alias("head"))

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        text, kept = g["head"].iloc[0], 0
        for x in g.sort_values("position")["line"]:
            if estimate(f"{text}\n{x}") >= budget:
                break
            text, kept = f"{text}\n{x}", kept + 1
        return pd.DataFrame([(g["repository"].iloc[0], text, estimate(text), kept < len(g))], columns=["repository", "text", "tokens", "truncated"])

    return lines.join(head, "repository").groupBy("repository").applyInPandas(fold, "repository string, text string, tokens long, truncated boolean")
