"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases, in DataFrame functions alone.

A paragraph is a line. A paragraph whose digest ends in 0 or 1 closes its section, and a phrase ends at
white space before one of a few letters, so both follow the content and an edit moves no boundary beyond
its own surroundings. Digests: SHA-256 of each paragraph, of a section's paragraph digests, and of all
section digests (the root). A fingerprint is the root (64 hex digits) and then, in the text's order, each
section's digest (8 digits, after ``;``), its paragraphs' (8 digits, after ``,``) and after each paragraph's
the marks of its phrases (4 digits each): about a quarter of the text's length.

Two fingerprints are compared from the root down: what is below an equal branch is never looked at, and
phrases are compared within paragraphs that differ only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Where a phrase ends: white space before these letters or any beyond Latin ones (about one word in three).
_PHRASE = r"\s+(?=[aehorAEHOR]|[^\u0000-\u024F\s])"
_MARK = 4
_MOST_BUCKETS = 100_000  #: bounds the list of cuts; beyond it buckets grow, which are sorted with spilling


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; a null text counts as empty."""
    marks = lambda p: F.transform(F.split(p, _PHRASE), lambda x: F.right(F.lower(F.hex(F.xxhash64(x))), F.lit(_MARK)))
    paragraphs = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda p: F.struct(F.sha2(p, 256).alias("digest"), F.array_join(marks(p), "").alias("marks")))
    closed = lambda x: F.when(F.right(x["digest"], F.lit(1)).isin("0", "1"), F.lit(";")).otherwise(F.lit(""))
    leaves = F.transform(paragraphs, lambda x: F.struct(
        F.concat(x["digest"], closed(x)).alias("digest"), F.concat(F.lit(","), F.left(x["digest"], F.lit(8)), x["marks"], closed(x)).alias("marks")))
    sections = lambda of, field: F.split(F.array_join(F.transform(of, lambda x: x[field]), ""), ";")
    tree = _once(leaves, lambda of: F.zip_with(sections(of, "digest"), sections(of, "marks"), lambda d, m: F.struct(F.sha2(d, 256).alias("digest"), m.alias("marks"))))
    return _once(tree, lambda of: F.concat(
        F.sha2(F.array_join(F.transform(of, lambda x: x["digest"]), ""), 256),
        F.array_join(F.transform(of, lambda x: F.concat(F.lit(";"), F.left(x["digest"], F.lit(8)), x["marks"])), "")))


def root(print_: Column) -> Column:
    return F.left(print_, F.lit(64))


def _below(branch: Column, mark: str) -> Column:
    """What follows each ``mark`` in a fingerprint or a part of one."""
    return F.slice(F.split(branch, mark), 2, 1 << 30)


def _phrases(branches: Column, heads: int) -> Column:
    """How many phrases branches have in all; ``heads`` is what each starts with beside its paragraphs."""
    paragraphs = lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit(","), F.lit("")))
    return F.aggregate(branches, F.lit(0), lambda n, x: n + ((F.char_length(x) - heads - 9 * paragraphs(x)) / _MARK).cast("int"))


def likeness(a: Column, b: Column) -> Column:
    """Twice the phrases that two fingerprints have in common by the phrases of both, from the root down.

    Equal roots are 1. Of sections, those that both have count with all their phrases; of the others'
    paragraphs likewise; and in paragraphs that only one has, distinct phrase marks are compared. A branch
    that a text repeats counts once.
    """
    halves = lambda x, y: F.struct(F.array_except(x, y).alias("x"), F.array_except(y, x).alias("y"), F.array_intersect(x, y).alias("both"))
    paragraphs = lambda sections: F.flatten(F.transform(sections, lambda s: _below(s, ",")))
    marks = lambda ps: F.array_distinct(F.flatten(F.transform(ps, lambda p: F.regexp_extract_all(F.substring(p, 9, 1 << 30), F.lit("(.{%d})" % _MARK), 1))))
    section = halves(_below(a, ";"), _below(b, ";"))

    def by_section(s):
        return _once(halves(paragraphs(s["x"]), paragraphs(s["y"])), lambda p: by_paragraph(_phrases(s["both"], 8), p))

    def by_paragraph(same, p):
        both = F.struct((same + _phrases(p["both"], 8)).alias("same"), marks(p["x"]).alias("x"), marks(p["y"]).alias("y"))
        return _once(both, lambda z: 2.0 * (z["same"] + F.size(F.array_intersect(z["x"], z["y"]))) / (2 * z["same"] + F.size(z["x"]) + F.size(z["y"])))

    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(_once(section, by_section))


def differing(a: Column, b: Column) -> Column:
    """Sections of fingerprint ``a`` (position, digest, differing paragraphs' positions in it) that ``b`` lacks:
    no branch below an equal section is looked at."""
    theirs = F.flatten(F.transform(F.array_except(_below(b, ";"), _below(a, ";")), lambda s: _below(s, ",")))

    def placed(known):
        gone = F.filter(F.transform(_below(a, ";"), lambda s, k: F.struct(k.alias("position"), s.alias("s"))), lambda x: ~F.array_contains(known["sections"], x["s"]))
        return F.transform(gone, lambda x: F.struct(
            x["position"].alias("position"), F.left(x["s"], F.lit(8)).alias("digest"),
            F.transform(F.filter(F.transform(_below(x["s"], ","), lambda p, k: F.struct(k.alias("k"), p.alias("p"))), lambda p: ~F.array_contains(known["paragraphs"], p["p"])), lambda p: p["k"]).alias("paragraphs")))

    return _once(F.struct(_below(b, ";").alias("sections"), theirs.alias("paragraphs")), placed)


def first_difference(a: Column, b: Column) -> Column:
    """The position of the first section of ``a`` that ``b`` lacks, null for none."""
    first = lambda s: F.array_position(s["a"], F.get(F.array_except(s["a"], s["b"]), F.lit(0)))
    return _once(F.struct(_below(a, ";").alias("a"), _below(b, ";").alias("b")), first) - 1


def with_next(docs: DataFrame, columns: list[str], rows_a_bucket: int = 5000) -> DataFrame:
    """Rows of ``docs`` (doc_id, ``columns``) with ``bucket``, ``guest`` and the order columns of ``following``.

    doc_id quantiles cut the table into buckets; each bucket also gets, as a guest, the first document of the
    next one (the last bucket that of the first), so what follows a document is in its bucket. Quantiles are
    values of the table, so a bucket's first document is the one with its lower bound.
    """
    stats = docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).first()
    count = max(1, min(_MOST_BUCKETS, stats["n"] // rows_a_bucket))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / count for k in range(1, count)] or [0.5], max(100_000, 10 * count)).alias("x")).first()["x"] if count > 1 else []
    cuts = sorted({x for x in cuts or [] if x > stats["least"]})
    bounds = F.array(*(F.lit(x).cast("long") for x in cuts)) if cuts else F.array().cast("array<long>")
    #: How many bounds are not above doc_id, by halving steps from the largest power of two on.
    bucket = F.lit(0)
    if cuts:
        step = 1 << (len(cuts).bit_length() - 1)
        halves = [step >> k for k in range(step.bit_length())]
        bucket = F.aggregate(
            F.array(*(F.lit(x) for x in halves)), F.lit(0),
            lambda low, x: F.when((low + x <= len(cuts)) & (F.get(bounds, low + x - 1) <= F.col("doc_id")), low + x).otherwise(low))
        bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(bucket)
    placed = docs.select("doc_id", *columns, bucket.alias("bucket"))
    own = F.struct(F.col("bucket"), F.lit(0).alias("wrap"), F.lit(False).alias("guest"))
    before = F.when((F.col("bucket") > 0) & (F.get(bounds, F.col("bucket") - 1) == F.col("doc_id")), F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(0).alias("wrap"), F.lit(True).alias("guest")))
    first = F.col("doc_id").eqNullSafe(F.lit(stats["least"]).cast("long"))
    last = F.when(first, F.struct(F.lit(len(cuts)).alias("bucket"), F.lit(1).alias("wrap"), F.lit(True).alias("guest")))
    at = F.explode(F.filter(F.array(own, before, last), lambda x: x.isNotNull())).alias("at")
    return placed.select("doc_id", *columns, at).select("doc_id", *columns, "at.*")


def following() -> Window:
    """The order of ``with_next``: ascending doc_id, nulls last, ties by text."""
    return Window.partitionBy("bucket").orderBy("wrap", F.col("doc_id").asc_nulls_last(), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of an edited one, whose last quarter is the start of the next document's.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and
    first_edit (the first section that the edited text lacks, null for none). A null text is empty. The next
    document is that of the next doc_id (nulls last, ties by text; the first follows the last, so one document
    follows itself); rows without a doc_id are ordered in one task. An empty table gives no rows. Other columns
    are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = following()
    rows = with_next(docs, ["text"]).withColumn("next", F.lead("text").over(order))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = rows.select(
        "*", n.cast("long").alias("n_chars"), fingerprint(F.col("text")).alias("fingerprint"),
        F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next", F.lit(1), quarter)).alias("edited")).drop("next")
    rows = rows.withColumn("next_fingerprint", F.lead("fingerprint").over(order)).where("NOT guest")
    rows = rows.select("*", fingerprint(F.col("edited")).alias("edited_fingerprint"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        first_difference(F.col("fingerprint"), F.col("edited_fingerprint")).alias("first_edit"))
