"""Markdown export of memories: an index and a page a type, in a fixed order, with line and byte caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import LIVE, MEMORY_TYPES, STATUSES


def _order(values, column) -> Column:
    return F.array_position(F.array(*map(F.lit, values)), column)


def _line(text: Column, most: int) -> Column:
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(plain) > most, F.concat(F.left(plain, F.lit(most - 1)), F.lit("…"))).otherwise(plain)


def pages(memories: DataFrame, line_chars: int = 120, page_bytes: int | None = None) -> DataFrame:
    """Lines of the export (page, position, line): memories by type, status, newest first, id.

    Lines stay rows, so a page of any length is written by as many tasks; ``written`` makes files of them. With
    ``page_bytes`` a page ends with the last line that fits, and a line that counts the rest.
    """
    rows = memories.select(
        F.col("type").alias("page"), _order(MEMORY_TYPES, F.col("type")).alias("a"), _order(STATUSES, F.col("status")).alias("b"), "observed_at", "id",
        F.concat(F.lit("- ["), F.col("id").cast("string"), F.lit("] ("), F.col("status"), F.lit(") "), _line(F.col("content"), line_chars)).alias("line"))
    order = ["a", "b", F.col("observed_at").desc(), "id"]
    if page_bytes is None:
        return rows.orderBy(*order).select("page", "line")
    # No more lines than the shortest ones that fill a page are ranked, so tasks keep that many each.
    by = Window.partitionBy("page").orderBy(*order)
    head = rows.withColumn("n", F.row_number().over(by)).where(F.col("n") <= page_bytes // 8)
    used = F.sum(F.octet_length("line") + 1).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = head.withColumn("used", used).where(F.col("used") <= page_bytes)
    totals = rows.groupBy("page", "a").agg(F.count("*").alias("all"))
    left = totals.join(kept.groupBy("page").agg(F.max("n").alias("shown")), "page", "left").withColumn("more", F.col("all") - F.coalesce("shown", F.lit(0))).where("more > 0")
    rest = left.select("page", "a", (F.coalesce("shown", F.lit(0)) + 1).alias("n"), F.concat(F.lit("… "), F.col("more").cast("string"), F.lit(" more")).alias("line"))
    return kept.select("page", "a", "n", "line").unionByName(rest).orderBy("a", "n").select("page", "line")


def index(memories: DataFrame) -> DataFrame:
    """The index page's lines: each type with its number of memories, in order."""
    g = memories.groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("status").isin(*LIVE)).alias("live"))
    line = F.concat(F.lit("- ["), "type", F.lit("](types/"), "type", F.lit(".md): "), F.col("live").cast("string"), F.lit(" of "), F.col("n").cast("string"))
    return g.orderBy(_order(MEMORY_TYPES, F.col("type"))).select(line.alias("line"))


def records(memories: DataFrame, most_bytes: int = 16_384) -> DataFrame:
    """One document for each memory (path, body): a head of its fields and its content, cut to the byte cap at a
    character's end."""
    head = F.concat(
        F.lit("---\nid: "), F.col("id").cast("string"), F.lit("\ntype: "), "type", F.lit("\nstatus: "), "status", F.lit("\nvalid_from: "), F.col("valid_from").cast("string"),
        F.coalesce(F.concat(F.lit("\nvalid_until: "), F.col("valid_until").cast("string")), F.lit("")), F.lit("\n---\n\n"))
    body = F.coalesce("content", F.lit(""))
    room = F.lit(most_bytes) - F.octet_length(head)
    #: The bytes are cut, and then what is left of a character that was cut through.
    cut = F.regexp_replace(F.make_valid_utf8(F.substr(F.encode(body, "UTF-8"), F.lit(1), room - 3).cast("string")), "\ufffd+$", "")
    return memories.select(F.concat(F.lit("memories/"), F.col("id").cast("string"), F.lit(".md")).alias("path"), F.concat(head, F.when(F.octet_length(body) <= room, body).otherwise(F.concat(cut, F.lit("…")))).alias("body"))


def written(memories: DataFrame, path: str) -> None:
    """One folder of text a type; the order within a folder is that of its part files' names."""
    pages(memories).write.partitionBy("page").mode("overwrite").text(path)
