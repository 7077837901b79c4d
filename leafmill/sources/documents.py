"""Reading documents of all formats into pages or sections, and writing markdown."""

from __future__ import annotations

import hashlib
import io
import os
import shutil
import subprocess
import tempfile
import time
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.markdown import create_markdown, markdown_path, page_label, suffix
from leafmill.operators.hybrid import Recognition, recognised_pages
from leafmill.operators.sections import render_blocks, split_sections
from leafmill.session import stage

#: Seconds a conversion by an office program may take.
CONVERSION_SECONDS = 120
OFFICE = (".doc", ".rtf", ".odt")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BLOCKS = "path string, pos long, kind string, style string, raw string, has_break boolean, cells array<array<string>>, error string"


def list_files(spark: SparkSession, folders: list[str], recursive: bool = False) -> DataFrame:
    """``(path, length, modificationtime)`` of files; contents are not read. Unreadable files are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true")
    return reader.load(folders).select("path", "length", F.col("modificationTime").alias("modificationtime"))


def load_files(spark: SparkSession, folders: list[str], recursive: bool = False) -> DataFrame:
    """``(path, content)`` of all files of folders; for some of them see ``read_files``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true")
    return reader.load(folders).select("path", "content")


def local_path(path: str) -> str:
    """Path on a file system that all executors mount."""
    return "/" + path.removeprefix("file:").lstrip("/")


def _open(path: str):
    return open(local_path(path), "rb")


def read_files(paths: DataFrame, opener: Callable[[str], object] = _open, per_task: int = 200) -> DataFrame:
    """``(path, content, error)`` of just these files, each opened where its row is worked on; contents pass no shuffle.

    ``opener`` returns a binary stream. A file that cannot be read has a null content and an error.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                content, error = None, None
                try:
                    with opener(path) as f:
                        content = f.read()
                except Exception as failure:
                    error = f"{type(failure).__name__}: {failure}"
                yield pd.DataFrame({"path": [path], "content": [content], "error": [error]})

    return _dealt(paths, per_task).mapInPandas(run, "path string, content binary, error string")


def _dealt(paths: DataFrame, per_task: int) -> DataFrame:
    """Paths over as many tasks as their number asks for."""
    rows = stage(paths.select("path"), "paths")
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // per_task)))


#: Bytes read at a time for a content hash, and seconds between two looks at a file's size.
CHUNK, SETTLE_SECONDS = 1 << 16, 0.5


def content_md5(stream) -> str:
    """MD5 of a stream's content in hexadecimal digits, read in pieces."""
    digest = hashlib.md5()
    while piece := stream.read(CHUNK):
        digest.update(piece)
    return digest.hexdigest()


def inspect_files(paths: DataFrame, wait: float = SETTLE_SECONDS, per_task: int = 200) -> DataFrame:
    """``(path, content_hash, problem)``: MD5 of each file, or why it must not be taken up now.

    Problems: it is not a file, another process has locked it, its size changed while it was looked at. A file system without
    locks is no problem. All files of a batch share one wait.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes: dict[str, int] = {}
            problem: dict[str, str] = {}
            for path in frame["path"]:
                at = local_path(path)
                if not os.path.isfile(at):
                    problem[path] = "not a file"
                elif _locked(at):
                    problem[path] = "locked"
                else:
                    sizes[path] = os.path.getsize(at)
            if sizes:
                time.sleep(wait)
            hashes: dict[str, str] = {}
            for path, size in sizes.items():
                try:
                    with open(local_path(path), "rb") as f:
                        hashes[path] = content_md5(f)
                    if os.path.getsize(local_path(path)) != size:
                        problem[path] = "size changed"
                except OSError:
                    problem[path] = "disappeared"
            yield pd.DataFrame({"path": frame["path"], "content_hash": [None if p in problem else hashes.get(p) for p in frame["path"]], "problem": [problem.get(p) for p in frame["path"]]})

    return _dealt(paths, per_task).mapInPandas(run, "path string, content_hash string, problem string")


def _locked(path: str) -> bool:
    import fcntl

    try:
        with open(path, "rb") as f:
            fcntl.flock(f.fileno(), fcntl.LOCK_SH | fcntl.LOCK_NB)
            fcntl.flock(f.fileno(), fcntl.LOCK_UN)
    except BlockingIOError:
        return True
    except OSError:
        return False
    return False


def existing_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, markdown)`` of the markdown files of a folder."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md")
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("markdown"))


def _text(element) -> str:
    out = []
    for node in element.iter():
        if node.tag == f"{_W}t":
            out.append(node.text or "")
        elif node.tag == f"{_W}tab":
            out.append("\t")
        elif node.tag in (f"{_W}br", f"{_W}cr") and node.get(f"{_W}type") in (None, "textWrapping"):
            out.append("\n")
    return "".join(out)


def _style_names(archive: zipfile.ZipFile) -> dict[str, str]:
    if "word/styles.xml" not in archive.namelist():
        return {}
    root = ElementTree.fromstring(archive.read("word/styles.xml"))
    names = {}
    for style in root.iter(f"{_W}style"):
        name = style.find(f"{_W}name")
        if name is not None:
            text = name.get(f"{_W}val", "")
            names[style.get(f"{_W}styleId", "")] = text[:1].upper() + text[1:] if text.startswith("heading") else text
    return names


def docx_blocks(content: bytes) -> list[tuple[str, str, str, bool, list[list[str]]]]:
    """Paragraphs and tables of a DOCX body in order: kind, style, text, page break, cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        styles = _style_names(archive)
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    out = []
    for element in body if body is not None else ():
        if element.tag == f"{_W}p":
            style = element.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            broken = any(b.get(f"{_W}type") == "page" for run in element.findall(f"{_W}r") for b in run.findall(f"{_W}br"))
            out.append(("paragraph", styles.get(name, name), _text(element).strip(), broken, []))
        elif element.tag == f"{_W}tbl":
            cells = [["\n".join(_text(p) for p in c.findall(f"{_W}p")) for c in row.findall(f"{_W}tc")] for row in element.findall(f"{_W}tr")]
            out.append(("table", "", "", False, cells))
    return out


def office_to_docx(content: bytes, extension: str) -> bytes:
    """DOCX of a file by a headless office program; raises if there is none or it fails."""
    program = shutil.which("libreoffice") or shutil.which("soffice")
    if not program:
        raise RuntimeError("LibreOffice is not installed")
    with tempfile.TemporaryDirectory() as folder:  # of the worker; nothing in it outlives the call
        source = os.path.join(folder, f"source{extension}")
        with open(source, "wb") as f:
            f.write(content)
        command = [program, f"-env:UserInstallation=file://{folder}/profile", "--headless", "--convert-to", "docx", "--outdir", folder, source]
        done = subprocess.run(command, capture_output=True, timeout=CONVERSION_SECONDS)
        result = os.path.join(folder, "source.docx")
        if done.returncode or not os.path.exists(result):
            raise RuntimeError(f"conversion failed: {done.stderr.decode(errors='replace')[:200]}")
        with open(result, "rb") as f:
            return f.read()


def pdf_pages(content: bytes) -> list[str]:
    """Text of each page of a PDF, by a reader that is not part of this library; raises without it."""
    try:
        import pymupdf
    except ImportError as missing:
        raise RuntimeError("no PDF reader is installed") from missing
    with pymupdf.open(stream=content, filetype="pdf") as document:
        return [page.get_text() for page in document]


def _extract(read_pdf: Callable[[bytes], list[str]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content, unread in zip(frame["path"], frame["content"], frame["error"]):
                extension = os.path.splitext(path)[1].lower()
                try:
                    if unread:
                        raise OSError(unread)
                    if extension == ".pdf":
                        for i, page in enumerate(read_pdf(bytes(content))):
                            rows.append((path, i, "page", "", page, i > 0, None, None))
                    elif extension == ".docx" or extension in OFFICE:
                        data = bytes(content) if extension == ".docx" else office_to_docx(bytes(content), extension)
                        found = docx_blocks(data) or [("paragraph", "", "", False, [])]
                        rows += [(path, i, kind, style, text, broken, cells, None) for i, (kind, style, text, broken, cells) in enumerate(found)]
                    else:
                        raise ValueError(f"Unsupported format: {extension}")
                except Exception as error:  # one broken file is a row with its error, not a failed job
                    rows.append((path, 0, "error", "", "", False, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return run


def extract_blocks(files: DataFrame, read_pdf: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    """Body blocks of files ``(path, content)`` and perhaps ``error``; a file that cannot be read has one row with its error."""
    files = files if "error" in files.columns else files.withColumn("error", F.lit(None).cast("string"))
    return files.select("path", "content", "error").mapInPandas(_extract(read_pdf), BLOCKS)


def extract_sections(files: DataFrame, read_pdf: Callable[[bytes], list[str]] = pdf_pages, recognition: Recognition | None = None) -> DataFrame:
    """``(path, section, text, error, used_ocr, ocr_chars)``: pages of PDF files, sections at page breaks of others.

    With ``recognition`` the pages of PDF files are made from their layout and recognised images.
    """
    none = {"used_ocr": F.lit(False), "ocr_chars": F.lit(0).cast("long")}
    if recognition is not None:
        is_pdf = suffix(F.col("path")) == ".pdf"
        found, _ = recognised_pages(files.where(is_pdf), recognition)
        read = found.select("path", F.col("page_num").cast("long").alias("section"), F.col("page_text").alias("text"), "error", "used_ocr", "ocr_chars")
        return extract_sections(files.where(~is_pdf), read_pdf).unionByName(read)
    blocks = extract_blocks(files, read_pdf)
    pages = blocks.where("kind = 'page'").select("path", (F.col("pos") + 1).cast("int").alias("section"), F.col("raw").alias("text"))
    body = render_blocks(blocks.where("kind IN ('paragraph', 'table')"))
    sections = split_sections(body.select("path", "pos", "text", "has_break"))
    errors = blocks.where("kind = 'error'").select("path", F.lit(0).alias("section"), F.lit("").alias("text"), "error")
    good = pages.unionByName(sections).withColumn("error", F.lit(None).cast("string"))
    return good.unionByName(errors).withColumns(none)


def documents(files: DataFrame, read_pdf: Callable[[bytes], list[str]] = pdf_pages, recognition: Recognition | None = None) -> DataFrame:
    """``(path, pages, markdown, output_path, error, ocr_pages, ocr_chars)`` per file."""
    s = extract_sections(files, read_pdf, recognition)
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("section", "text")))), lambda x: x["text"])
    grouped = s.groupBy("path").agg(ordered.alias("pages"), F.max("error").alias("error"), F.count_if("used_ocr").alias("ocr_pages"), F.sum("ocr_chars").alias("ocr_chars"))
    path = F.col("path")
    return grouped.select(
        "path", "pages", F.when(F.col("error").isNull(), create_markdown(path, F.col("pages"), page_label(path))).alias("markdown"),
        markdown_path(path).alias("output_path"), "error", "ocr_pages", "ocr_chars",
    )


def supported(files: DataFrame) -> DataFrame:
    return files.where(suffix(F.col("path")).isin(".pdf", ".docx", *OFFICE))


def write_markdown(rendered: DataFrame) -> None:
    """Writes each document's markdown to its output path on a file system all executors mount.

    A file is written under another name and renamed, so no reader sees half of it and a repeated task is harmless.
    """

    def write(rows) -> None:
        for row in rows:
            target = local_path(row.output_path)
            draft = f"{target}.{os.getpid()}.part"
            with open(draft, "w", encoding="utf-8") as f:
                f.write(row.markdown)
            os.replace(draft, target)

    rendered.where("error IS NULL AND markdown IS NOT NULL").select("output_path", "markdown").foreachPartition(write)


def existing_outputs(rendered: DataFrame, markdown: DataFrame) -> DataFrame:
    """Adds ``exists`` and ``old_markdown`` by output path."""
    m = markdown.select(F.col("path").alias("output_path"), F.col("markdown").alias("old_markdown")).withColumn("_e", F.lit(True))
    return rendered.join(m, "output_path", "left").withColumn("exists", F.coalesce("_e", F.lit(False))).drop("_e")
