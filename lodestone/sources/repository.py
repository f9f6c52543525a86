"""Snapshots of source trees from binary files, and git's record formats as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_excluded

LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "go": "go", "rs": "rust", "java": "java"}


def blob_hash(content: Column) -> Column:
    """The object id git gives a file's bytes."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string"), F.lit("\0")), "UTF-8"), content))


def snapshot(spark: SparkSession, root: str, most_bytes: int = 1 << 20) -> DataFrame:
    """Files under a folder: path, blob, size and why one was skipped (excluded, too large), if it was.

    Sizes come with the listing, so files that are too large are never read. Files whose names begin with a
    dot or an underscore are not listed at all, as by any of Spark's file sources.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", r"^.*?\Q" + root.rstrip("/").split("://")[-1] + r"\E/", "")
    skipped = F.when(is_excluded(path), "excluded").when(F.col("length") > most_bytes, "too_large")
    small = files.where(F.col("length") <= most_bytes).select(path.alias("path"), F.col("length").alias("size"), skipped.alias("skipped"), F.when(skipped.isNull(), blob_hash(F.col("content"))).alias("blob"))
    large = files.where(F.col("length") > most_bytes).select(path.alias("path"), F.col("length").alias("size"), skipped.alias("skipped"), F.lit(None).cast("string").alias("blob"))
    return small.union(large)


def index_entries(listing: Column) -> Column:
    """Records of a NUL-delimited index listing (mode, blob, stage, path)."""
    parts = F.filter(F.split(listing, "\0"), lambda x: x != "")
    field = lambda x, k: F.regexp_extract(x, r"^(\d{6}) ([0-9a-f]{40,64}) (\d)\t([\s\S]+)$", k)
    return F.transform(parts, lambda x: F.struct(field(x, 1).alias("mode"), field(x, 2).alias("blob"), field(x, 3).alias("stage"), field(x, 4).alias("path")))


def captured(files: DataFrame, listings: DataFrame) -> DataFrame:
    """A repository's state from a snapshot (path, blob, skipped) and index listings (listing): path, blob, tier and
    skipped.

    A file whose bytes are those in the index is 'committed', one that differs or isn't in it 'worktree', one that
    is in the index alone 'missing'. A file that was skipped has no blob and no tier. Entries of a merge under way
    (a stage other than 0) and of other repositories (mode 160000) don't count.
    """
    entry = F.explode(index_entries(F.col("listing"))).alias("e")
    staged = listings.select(entry).select("e.*").where("stage = '0' AND mode <> '160000'").groupBy("path").agg(F.max("blob").alias("staged"))
    both = files.select("path", "blob", "skipped").join(staged, "path", "full_outer")
    tier = F.when(F.col("skipped").isNotNull(), None).when(F.col("blob").isNull(), "missing").when(F.col("blob") == F.col("staged"), "committed").otherwise("worktree")
    return both.select("path", "blob", tier.alias("tier"), "skipped")


def valid_path(path: Column) -> Column:
    """Whether a path can be one of a repository: relative, with no empty part, none that goes up, and no NUL."""
    return (path != "") & ~path.rlike(r"(?:^|/)(?:\.\.?)?(?:/|$)|[\x00\\]|^[A-Za-z]:")


def _fields(listing: Column) -> Column:
    """The fields of a NUL-terminated listing; null where the last one isn't ended."""
    whole = (listing == "") | F.endswith(listing, F.lit("\0"))
    return F.when(whole, F.when(listing == "", F.array().cast("array<string>")).otherwise(F.split(F.substring(listing, F.lit(1), F.char_length(listing) - 1), "\0")))


def path_entries(listing: Column) -> Column:
    """Paths of a NUL-terminated listing; null for one that isn't ended or has a path that can't be."""
    fields = _fields(listing)
    return F.when(F.forall(fields, valid_path), fields)


def rename_entries(listing: Column) -> Column:
    """Renames (previous_path, path) of a NUL-terminated diff with statuses; null where it can't be read.

    A status has one path, a rename or a copy two. Fields are read in one pass, which carries what it waits for.
    """
    empty = F.array().cast("array<struct<previous_path:string,path:string>>")
    start = F.struct(F.lit("").alias("status"), F.lit(None).cast("string").alias("before"), empty.alias("found"), F.lit(False).alias("bad"))

    def step(s, x):
        two = s["status"].rlike("^[RC]")
        first, second = two & s["before"].isNull(), two & s["before"].isNotNull()
        is_status = x.rlike(r"^(?:[ACDMRTUXB]|[RC]\d{1,3})$")
        fresh = s["status"] == ""
        status = F.when(fresh, x).when(first, s["status"]).otherwise("")
        before = F.when(~fresh & first, x)
        pair = F.array(F.struct(s["before"].alias("previous_path"), x.alias("path")))
        found = F.when(~fresh & second & s["status"].startswith("R"), F.concat(s["found"], pair)).otherwise(s["found"])
        bad = s["bad"] | F.when(fresh, ~is_status).otherwise(~valid_path(x))
        return F.struct(status.alias("status"), before.alias("before"), found.alias("found"), bad.alias("bad"))

    return F.aggregate(_fields(listing), start, step, lambda s: F.when(~s["bad"] & (s["status"] == ""), s["found"]))


def language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.(\w+)$", 1)))
