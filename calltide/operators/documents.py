"""Clean-up of rule books converted to Markdown, trimming of turn logs, and the context of a project folder."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltide.functions.text import col, digest_parent, heading_level, let, lines, strip, strip_right

#: The shapes of lines and blocks that conversion leaves behind.
OMITTED_PICTURE = r"^\*\*==> picture \[[^\]]+\] intentionally omitted <==\*\*\s*$"
PAGE_NUMBER = r"^Page \d+\s*$|^\d{1,3}\s*$"
PICTURE_TEXT = r"(?U)\*\*----- Start of picture text -----\*\*<br>\s*\n([^\n]+?)<br>\*\*----- End of picture text -----\*\*<br>\s*\n"
SECTION_NUMBER = r"(?U)^(\d+(?:\.\d+){0,3})\b"
BANNER_REPEATS = 4
BANNER_MOST_CHARS = 60
KEEP_TURNS = 3


def _picture_heading(block: Column) -> Column:
    """A block's text as a heading of the level of its section number, or in bold where it begins with none."""
    section = F.regexp_extract(block, SECTION_NUMBER, 1)
    mark = F.repeat(F.lit("#"), heading_level(section).cast("int"))
    return F.when(section == "", F.concat(F.lit("**"), block, F.lit("**"))).otherwise(F.concat(mark, F.lit(" "), block))


def promote_picture_text(md: Column | str) -> Column:
    """Blocks of picture text as headings by their section number, others in bold: the text between blocks stays as it is.

    Most texts have none, so the patterns run only over those with the words that begin a block.
    """
    return F.when(col(md).contains("Start of picture text"), _promoted(md)).otherwise(col(md))


def _promoted(md: Column | str) -> Column:
    headings = F.transform(F.regexp_extract_all(col(md), F.lit(PICTURE_TEXT), F.lit(1)), lambda b: F.concat(_picture_heading(strip(b)), F.lit("\n\n")))
    return F.array_join(F.zip_with(F.split(col(md), PICTURE_TEXT), headings, lambda part, heading: F.concat(part, F.coalesce(heading, F.lit("")))), "")


def _banner_shaped(line: Column, stripped: bool = False) -> Column:
    s = line if stripped else strip(line)
    return (s != "") & (F.length(s) <= BANNER_MOST_CHARS) & ~s.startswith("#") & ~s.startswith("**==>") & ~s.startswith("- ")


def banner_lines(docs: DataFrame, key: str, text: str, repeats: int = BANNER_REPEATS) -> DataFrame:
    """(key, line, n): short lines that stand at least ``repeats`` times in one document."""
    rows = docs.select(key, F.explode(lines(text)).alias("line")).where(_banner_shaped(F.col("line")))
    return rows.groupBy(key, strip("line").alias("line")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= repeats)


def clean_markdown(md: Column | str, repeats: int = BANNER_REPEATS) -> Column:
    """Headings from picture text; no omitted pictures, page numbers or repeated banners; at most one blank line on end.

    One expression over the text of a document, so nothing is shuffled. A line repeats where the sorted stripped lines
    have it ``repeats`` places on as well.
    """
    banners = lambda shaped: F.array_distinct(F.filter(shaped, lambda s, i: F.get(shaped, i + F.lit(repeats - 1)) == s))
    # each line is stripped once; only lines that begin like a picture's or a page number's meet the patterns
    read = lambda x: let(strip(x), lambda s: F.struct(x.alias("x"), s.alias("s"), _banner_shaped(s, stripped=True).alias("shaped")))
    sorted_banners = lambda parts: let(F.sort_array(F.transform(F.filter(parts, lambda p: p["shaped"]), lambda p: p["s"])), banners)
    picture = lambda p: p["s"].startswith("**==>") & p["x"].rlike(OMITTED_PICTURE)
    number = lambda p: (p["s"].startswith("Page ") | (F.length(p["s"]) <= 3)) & p["s"].rlike(PAGE_NUMBER)
    noise = lambda p, found: picture(p) | number(p) | (p["shaped"] & F.array_contains(found, p["s"]))
    kept = let(F.transform(lines(promote_picture_text(md)), read), lambda parts: let(sorted_banners(parts), lambda found: F.transform(F.filter(parts, lambda p: ~noise(p, found)), lambda p: p["x"])))
    return F.concat(strip(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n")), F.lit("\n"))


def trim_turns(text: Column | str, keep: int = KEEP_TURNS) -> Column:
    """A turn log (newest first) up to its first ``keep`` turns, with a note of how many are left out."""

    def trimmed(parts: Column) -> Column:
        turns = F.size(F.filter(parts, lambda p: p.startswith("## Turn ")))
        head = strip_right(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - turns + keep), ""))
        note = F.concat(F.lit("\n\n---\n\n_("), (turns - keep).cast("string"), F.lit(" earlier turn(s) omitted from preamble; full history in turn-log.md)_\n"))
        return F.when(turns <= keep, col(text)).otherwise(F.concat(head, note))

    return let(F.split(col(text), r"(?m)(?=^## Turn )"), trimmed)


def prefer_digest(rules: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """Each rule book by name, with its digest in its place where there is one; a digest without its book is left out."""
    digest = F.col(name).endswith(".digest.md")
    books = rules.where(~digest).select(F.col(name).alias("book"), F.col(text).alias("__text"), F.regexp_replace(F.col(name), r"\.md$", "").alias("stem"))
    short = rules.where(digest).select(digest_parent(name).alias("stem"), F.col(name).alias("__digest"), F.col(text).alias("__short"))
    return books.join(short, "stem", "left").select("book", F.coalesce("__digest", "book").alias(name), F.coalesce("__short", "__text").alias(text))


def indented_json(text: str | None) -> str | None:
    """One small JSON file written again with an indent of two; None where it is absent or malformed."""
    try:
        return json.dumps(json.loads(text), indent=2) if text is not None else None
    except ValueError:
        return None


def project_context(mission: str | None, tasks: str | None, turn_log: str | None, rules: DataFrame) -> DataFrame:
    """One row ``context``: the project's files as sections, rule books by name; absent files and tasks that are no JSON are left out."""
    book = F.concat(F.lit("### rules/"), F.col("name"), F.lit("\n\n"), F.col("text"), F.lit("\n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("book", book.alias("section")))), lambda x: x["section"]), "\n")
    one = prefer_digest(rules).agg(F.nullif(joined, F.lit("")).alias("books"))
    parts = []
    if mission is not None:
        parts.append(F.lit(f"### MISSION.md\n\n{mission}\n"))
    tasks = indented_json(tasks)
    if tasks is not None:
        parts.append(F.lit(f"### tasks.json\n\n```json\n{tasks}\n```\n"))
    if turn_log is not None:
        parts.append(F.concat(F.lit("### turn-log.md\n\n"), trim_turns(F.lit(turn_log)), F.lit("\n")))
    return one.select(F.concat_ws("\n", *parts, "books").alias("context"))


def project_contexts(projects: DataFrame, rules: DataFrame, key: str = "project") -> DataFrame:
    """(key, context) of every row of ``projects`` (key, mission, tasks, turn_log), as ``project_context`` makes it of one.

    ``rules`` are (key, name, text); a project's books are gathered, since its context is one text. Tasks that are no JSON
    are left out, so are absent files; a project without any of it has an empty context.
    """

    def indented(texts: pd.Series) -> pd.Series:
        return texts.map(indented_json)

    books = rules.where(~F.col("name").endswith(".digest.md")).select(key, F.col("name").alias("book"), F.col("text").alias("__text"), F.regexp_replace("name", r"\.md$", "").alias("__stem"))
    short = rules.where(F.col("name").endswith(".digest.md")).select(key, digest_parent("name").alias("__stem"), F.col("name").alias("__digest"), F.col("text").alias("__short"))
    preferred = books.join(short, [key, "__stem"], "left")
    section = F.concat(F.lit("### rules/"), F.coalesce("__digest", "book"), F.lit("\n\n"), F.coalesce("__short", "__text"), F.lit("\n"))
    listed = preferred.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("book", section.alias("section")))), lambda x: x["section"]), "\n").alias("__books"))
    one = projects.withColumn("__tasks", F.pandas_udf(indented, "string")("tasks")).join(listed, key, "left")
    part = lambda head, body, tail: F.concat(F.lit(head), body, F.lit(tail))
    parts = [part("### MISSION.md\n\n", F.col("mission"), "\n"), part("### tasks.json\n\n```json\n", F.col("__tasks"), "\n```\n"), part("### turn-log.md\n\n", trim_turns("turn_log"), "\n"), F.nullif("__books", F.lit(""))]
    return one.select(key, F.concat_ws("\n", *parts).alias("context"))


def repeated_lines_by_window(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines with their place and how often their document has them; for documents too long for one expression."""
    rows = docs.select(key, F.posexplode(lines(text)).alias("place", "line"))
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key, strip("line"))))


