"""Session context and project digest: sections of whole lines packed into token allowances."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scopes import clipped, label
from .packing import estimate

# A section's tokens and lines in a session context, and shares of a digest.
SECTIONS = (("digest", 200, 40), ("decision", 250, 8), ("failure", 150, 6), ("procedural", 100, 6), ("preference", 50, 6))
DIGEST = (("decision", 0.5, "top decisions:"), ("failure", 0.3, "known failures:"), ("procedural", 0.2, "procedures:"))


def section_lines(current: DataFrame, line_chars: int = 120) -> DataFrame:
    """The lines of each project's sections: project_id, section, position, id, line.

    Decisions and failures newest first, the rest by importance; so many of each section as it may show, so
    a project's lines are few whatever it holds.
    """
    by_time = F.col("type").isin("decision", "failure")
    order = [F.when(by_time, F.lit(0.0)).otherwise(F.col("importance")).desc(), F.col("observed_at").desc(), F.col("id").desc()]
    most = F.create_map(*(F.lit(x) for kind, _, n in SECTIONS for x in (kind, n)))
    rows = current.where(F.col("type").isin(*(s[0] for s in SECTIONS)) & F.col("project_id").isNotNull())
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("project_id", "type").orderBy(*order))).where(F.col("position") <= F.element_at(most, F.col("type")))
    return rows.select("project_id", F.col("type").alias("section"), "position", "id", F.concat(F.lit("- "), label(F.col("content"), line_chars)).alias("line"))


def digest_lines(projects: DataFrame) -> DataFrame:
    """Lines of projects' digests (project_id, name, description, digest: a map of texts): name, description, entries
    by their keys, as rows of ``section_lines``."""
    entries = F.filter(F.map_entries(F.coalesce("digest", F.create_map().cast("map<string,string>"))), lambda x: F.coalesce(x["value"], F.lit("")) != "")
    entries = F.transform(F.array_sort(entries), lambda x: F.concat(F.replace(x["key"], F.lit("_"), F.lit(" ")), F.lit(": "), clipped(x["value"], 240)))
    said = F.when(F.coalesce("description", F.lit("")) != "", F.array(F.concat(F.lit("description: "), clipped(F.col("description"), 200)))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(F.concat(F.lit("project: "), "name")), said, entries)
    rows = projects.select("project_id", F.posexplode(lines).alias("position", "line")).where(F.col("position") < SECTIONS[0][2])
    return rows.select("project_id", F.lit("digest").alias("section"), (F.col("position") + 1).alias("position"), F.lit(None).cast("long").alias("id"), "line")


def packed_sections(lines: dict[str, list[str]], budget: int) -> tuple[list[tuple[str, list[str]]], int]:
    """Whole lines that fit each section's tokens and what earlier sections left over."""
    out, used, carried = [], 0, 0
    for kind, share, _ in SECTIONS:
        allowance, mine, spent = min(budget - used, share + carried), [], 0
        for line in lines.get(kind, []):
            if 0 < estimate(line) <= allowance - spent:
                mine.append(line)
                spent += estimate(line)
        carried = max(0, allowance - spent)
        if mine:
            out.append((kind, mine))
            used += spent
    return out, used


def packed_digest(name: str, lines: dict[str, list[str]], budget: int) -> tuple[str, int]:
    """A digest: the project's name, then sections by their shares of the rest, with what is left carried on.
    A section without a fitting line has no title either. Each line costs its break too."""
    cost = lambda x: estimate(x + "\n")
    out = [f"project: {name}"]
    used = cost(out[0])
    rest, carried = max(0, budget - used), 0
    for kind, share, title in DIGEST:
        allowance, mine, spent = int(rest * share) + carried, [], cost(title)
        for line in lines.get(kind, []):
            if cost(line) <= allowance - spent:
                mine.append(line)
                spent += cost(line)
        carried = allowance - spent if mine else allowance
        if mine:
            out += [title, *mine]
            used += spent
    return "\n".join(out), used


def _by_section(g: pd.DataFrame) -> dict[str, list[str]]:
    return {k: x.sort_values("position")["line"].tolist() for k, x in g.groupby("section")}


def contexts(current: DataFrame, budget: int = 750, projects: DataFrame | None = None) -> DataFrame:
    """Each project's session context: project_id, used tokens and text. With ``projects`` the digest comes first; a
    project without memories has its digest alone."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        parts, used = packed_sections(_by_section(g), budget)
        return pd.DataFrame([(g["project_id"].iloc[0], used, "\n\n".join("\n".join(x) for _, x in parts))], columns=["project_id", "used", "text"])

    lines = section_lines(current)
    if projects is not None:
        lines = lines.unionByName(digest_lines(projects))
    return lines.groupBy("project_id").applyInPandas(fold, "project_id string, used long, text string")


def digests(current: DataFrame, budget: int = 300) -> DataFrame:
    """Each project's digest: project_id, used tokens and text."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        text, used = packed_digest(g["project_id"].iloc[0], _by_section(g), budget)
        return pd.DataFrame([(g["project_id"].iloc[0], used, text)], columns=["project_id", "used", "text"])

    return section_lines(current).groupBy("project_id").applyInPandas(fold, "project_id string, used long, text string")
