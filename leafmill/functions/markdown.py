"""Rendering of extracted documents as markdown, and its inverse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"


def strip(text: Column) -> Column:
    """Text without white space of any script at its ends."""
    return F.regexp_replace(text, f"^{_EDGE}|{_EDGE}$", "")


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot starts no suffix."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)


def suffix(path: Column) -> Column:
    """Last suffix in lower case with its dot, empty without one."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"^.+(\.[^.]+)$", 1))


def markdown_path(path: Column) -> Column:
    """The sibling file with the suffix .md."""
    return F.when(suffix(path) != "", F.regexp_replace(path, r"\.[^./]+$", ".md")).otherwise(F.concat(path, F.lit(".md")))


def page_label(path: Column) -> Column:
    """Page for PDF files, Section for others."""
    return F.when(suffix(path) == ".pdf", "Page").otherwise("Section")


def create_markdown(path: Column, pages: Column, label: Column) -> Column:
    """Frame of title and source, then the pages; pages from the second on follow a rule and their label."""
    body = F.transform(
        pages, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("\n---\n*"), label, F.lit(" "), (i + 1).cast("string"), F.lit("*\n"), p))
    )
    head = F.concat(F.lit("# "), stem(path), F.lit("\n\n> Source: "), path, F.lit("\n\n---\n\n"))
    return F.concat(head, F.array_join(body, "\n"))


def strip_metadata(markdown: Column) -> Column:
    """Markdown without headings, quotes, rules and page labels; other lines stay as they are."""

    def keep(line: Column) -> Column:
        s = strip(line)
        label = s.startswith("*Page") & s.endswith("*")
        return ~(s.startswith("#") | s.startswith(">") | (s == "---") | label)

    return F.array_join(F.filter(F.split(markdown, "\n", -1), keep), "\n")


def join_pages(pages: Column) -> Column:
    return F.array_join(pages, "\n")


def join_blocks(blocks: Column) -> Column:
    """Blocks ``(y0, seq, text)`` from top to bottom, stripped, blank ones left out, with a blank line between."""
    texts = F.transform(F.array_sort(blocks), lambda b: strip(b["text"]))
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n\n")


def heading(style: Column, text: Column) -> Column:
    """A paragraph as a markdown heading if its style says so; the level is the first number of the style, or 1."""
    level = F.coalesce(F.regexp_extract(style, r"\d+", 0).try_cast("int"), F.lit(1))
    return F.when(style.startswith("Heading"), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).otherwise(text)


def table_markdown(rows: Column) -> Column:
    """Rows of cells as a markdown table with a rule after the first row; an empty table gives an empty text."""
    lines = F.transform(
        rows,
        lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(strip(c), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |")),
    )
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(rows, 0), lambda c: F.lit("---")), " | "), F.lit(" |"))
    all_lines = F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))))
    return F.when(F.size(rows) > 0, F.array_join(all_lines, "\n")).otherwise("")
