"""Pages and sections of documents as rows, and the markdown they make up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.markdown import heading, page_label, stem, table_markdown
from leafmill.operators.order import with_running_sum


def pages_of(documents: DataFrame, pages: Column, *keys: str) -> DataFrame:
    """One row per page of an array, numbered from 1."""
    return documents.select(*keys, F.posexplode(pages).alias("_pos", "page_text")).withColumn("page_num", F.col("_pos") + 1).drop("_pos")


def split_sections(paragraphs: DataFrame) -> DataFrame:
    """``(path, section, text)`` from paragraphs ``(path, pos, text, has_break)``.

    A paragraph with a break starts a section unless the current one is empty. Sections are numbered from 1;
    a document without text has one empty section.
    """
    breaks = F.coalesce(F.col("has_break").cast("int"), F.lit(0))
    marked = with_running_sum(paragraphs.withColumn("_filled", F.coalesce(F.col("text"), F.lit("")) != ""), "path", breaks, "_break", "pos", "_filled")
    starts = marked.where("_filled").select(F.col("path").alias("_path"), F.col("_break").alias("_start")).distinct()
    numbers = with_running_sum(starts, "_path", F.lit(1), "section", "_start")
    same = F.col("path").eqNullSafe(F.col("_path")) & (F.col("_break") == F.col("_start"))
    texts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    numbered = marked.where("_filled").join(numbers, same).groupBy("path", "section").agg(F.array_join(F.transform(texts, lambda x: x["text"]), "\n").alias("text"))
    without = marked.groupBy("path").agg(F.count_if("_filled").alias("_n")).where("_n = 0")
    return numbered.unionByName(without.select("path", F.lit(1).cast("long").alias("section"), F.lit("").alias("text")))


def render_blocks(blocks: DataFrame) -> DataFrame:
    """Adds ``text`` to body blocks ``(kind, style, raw, cells)``: headings and tables as markdown.

    A table stands between blank lines; an empty one leaves nothing.
    """
    table = table_markdown(F.col("cells"))
    framed = F.when(table != "", F.concat(F.lit("\n"), table, F.lit("\n"))).otherwise("")
    text = F.when(F.col("kind") == "table", framed).otherwise(heading(F.coalesce("style", F.lit("")), F.coalesce("raw", F.lit(""))))
    return blocks.withColumn("text", text)


def markdown_parts(pages: DataFrame) -> DataFrame:
    """Adds ``part`` to pages ``(path, page_num, page_text)``: what the page adds to its document's markdown.

    The parts of a path in order of pages, joined by line ends, are its markdown. A document of any number of
    pages needs no group, so a bound volume is no hot spot.
    """
    head = F.concat(F.lit("# "), stem(F.col("path")), F.lit("\n\n> Source: "), F.col("path"), F.lit("\n\n---\n\n"))
    ahead = F.concat(F.lit("\n---\n*"), page_label(F.col("path")), F.lit(" "), F.col("page_num").cast("string"), F.lit("*\n"))
    text = F.coalesce("page_text", F.lit(""))
    return pages.withColumn("part", F.when(F.col("page_num") == 1, F.concat(head, text)).otherwise(F.concat(ahead, text)))
