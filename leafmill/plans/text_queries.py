"""Quality, markdown and text queries over the driver's tables, with their DuckDB SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import markdown as md
from leafmill.functions import strings as st
from leafmill.functions import text_quality as tq
from leafmill.operators import sections
from leafmill.session import table, text_table

_C = "[bcdfghjklmnpqrstvwxz]{5,}"
_WORDS = ", ".join(f"'{w}'" for w in dict.fromkeys(tq.COMMON_WORDS))


def quality_ctes(source: str, out: str = "q") -> str:
    """CTEs that score rows ``(id, t)`` of a source into ``out``."""
    return f"""
{out}_a AS (SELECT id, t, CASE WHEN t IS NULL OR regexp_full_match(t, '[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]*') THEN []
  ELSE list_filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]+')) END AS w FROM {source}),
{out}_b AS (SELECT id, t, len(w)::DOUBLE AS n, len(list_filter(w, lambda x: x IN ({_WORDS})))::DOUBLE AS c,
  (len(list_filter(range(1, length(t) - 2), lambda i: t[i] <> chr(10) AND t[i] = t[i+1] AND t[i] = t[i+2] AND t[i] = t[i+3] AND (i = 1 OR t[i-1] <> t[i])))
   + len(regexp_extract_all(t, '(?i){_C}'))
   + len(list_filter(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '(?i){_C}')))
   + len(regexp_extract_all(t, '(?i)â€|Ã©|Ã¨|Ã |ï»¿|\\x{{fffd}}|\\\\x[0-9a-f]{{2}}'))
   + len(regexp_extract_all(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{{7f}}-\\x{{9f}}]')))::DOUBLE AS g,
  len(regexp_extract_all(t, '[.!?]'))::DOUBLE AS s FROM {out}_a),
{out}_c AS (SELECT id, t, n, CASE WHEN n > 0 THEN c / n ELSE 0::DOUBLE END AS r,
  CASE WHEN n > 0 THEN least(1::DOUBLE, log10(n + 1) / 4::DOUBLE) ELSE 0::DOUBLE END AS k,
  CASE WHEN n > 0 THEN least(1::DOUBLE, g / greatest(n / 10::DOUBLE, 1::DOUBLE)) ELSE 0::DOUBLE END AS g,
  CASE WHEN n > 0 THEN least(1::DOUBLE, s / (n / 15::DOUBLE)) ELSE 0::DOUBLE END AS p FROM {out}_b),
{out} AS (SELECT id, t, CAST(n AS INTEGER) AS word_count, r, k, g, p,
  greatest(0::DOUBLE, least(1::DOUBLE, r * 0.35::DOUBLE + k * 0.30::DOUBLE - g * 0.20::DOUBLE + p * 0.15::DOUBLE)) AS total FROM {out}_c)"""


def _metrics(df: DataFrame) -> list:
    return [F.round(m, 6).alias(m) if m != "word_count" else F.col(m) for m in tq.METRICS]


_SQL_METRICS = (
    "round(r, 6) AS real_word_ratio, round(k, 6) AS content_score, round(g, 6) AS gibberish_penalty, "
    "round(p, 6) AS punctuation_score, round(total, 6) AS total_score, word_count"
)


def quality(spark: SparkSession, d: str) -> DataFrame:
    """A1, F1-F8: score of every document."""
    df = tq.with_quality(text_table(spark, d, "documents").select("doc_id", "text"), "text")
    return df.select("doc_id", *_metrics(df))


def page_quality(spark: SparkSession, d: str) -> DataFrame:
    """A1 over pages, mean by engine; repeated rows count once."""
    pages = text_table(spark, d, "extracted_pages").select("page_id", "engine", "page_text").distinct()
    df = tq.with_quality(pages, "page_text")
    return df.groupBy("engine").agg(F.count("*").alias("pages"), F.round(F.avg("total_score"), 6).alias("avg_score"), F.sum("word_count").alias("words"))


def useful(spark: SparkSession, d: str) -> DataFrame:
    """Documents worth recognising, by language."""
    df = tq.with_quality(text_table(spark, d, "documents").select("lang", "text"), "text")
    good = tq.is_useful(F.col("total_score"), F.col("real_word_ratio"), F.col("text"))
    return df.groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(good).alias("useful"), F.round(F.avg("total_score"), 6).alias("avg_score"))


def improve(spark: SparkSession, d: str) -> DataFrame:
    """Stripped old markdown, its paragraphs as pages and every third of them damaged, against the text; both in one pass over the rows."""
    path = F.col("path")
    pages = F.transform(F.split("text", "\n\n", -1), lambda p, i: F.when(i % 3 == 1, F.translate(p, "aeo", "4€0")).otherwise(p))
    old = md.strip_metadata(md.create_markdown(path, pages, md.page_label(path)))
    docs = text_table(spark, d, "documents").select("doc_id", old.alias("old_text"), md.strip_metadata(F.col("text")).alias("new_text"))
    both = tq.with_quality(tq.with_quality(docs, "old_text", "old_"), "new_text", "new_")
    delta = F.col("new_total_score") - F.col("old_total_score")
    return both.select(
        "doc_id", F.round("old_total_score", 6).alias("old_score"), F.round("new_total_score", 6).alias("new_score"),
        (delta > 0).alias("better"), tq.delta_class(F.round(delta, 9)).alias("change"),
    )


def markdown(spark: SparkSession, d: str) -> DataFrame:
    """Documents rendered from their paragraphs as pages."""
    docs = text_table(spark, d, "documents").where("path IS NOT NULL")
    pages = F.split("text", "\n\n", -1)
    return docs.select("doc_id", md.create_markdown(F.col("path"), pages, md.page_label(F.col("path"))).alias("markdown"), md.markdown_path(F.col("path")).alias("output_path"))


def markdown_parts(spark: SparkSession, d: str) -> DataFrame:
    """T2, N1 without groups: what each page adds to its document's markdown."""
    pages = text_table(spark, d, "extracted_pages").select("page_id", "path", "page_num", "page_text").distinct()
    return sections.markdown_parts(pages).select("page_id", F.md5("part").alias("part_md5"))


def stripped(spark: SparkSession, d: str) -> DataFrame:
    """Documents without markdown frame."""
    docs = text_table(spark, d, "documents")
    return docs.select("doc_id", F.md5(md.strip_metadata(F.col("text"))).alias("body_md5"))


def words(spark: SparkSession, d: str) -> DataFrame:
    """Words between white space and length in characters."""
    return text_table(spark, d, "documents").select("doc_id", st.word_count(F.col("text")).alias("words"), F.length("text").alias("chars"))


def paths(spark: SparkSession, d: str) -> DataFrame:
    """Path helpers over Windows forms of all listed paths."""
    listed = table(spark, d, "file_listing").select("path").distinct()
    win = F.concat(F.upper(F.substring("path", 6, 1)), F.lit(":\\"), F.translate(F.expr("substring(path, 8)"), "/", "\\"))
    w = listed.withColumn("windows", F.when(F.col("path").startswith("/mnt/"), win).otherwise(F.col("path")))
    return w.select(
        "path", st.convert_windows_path(F.col("windows")).alias("converted"), st.truncate_path(F.col("path"), 20).alias("short"),
        md.stem(F.col("path")).alias("stem"), md.suffix(F.col("path")).alias("suffix"), md.page_label(F.col("path")).alias("label"),
    )


def tables(spark: SparkSession, d: str) -> DataFrame:
    """Cells as markdown tables and headings of invented styles."""
    docs = text_table(spark, d, "documents").select("doc_id", "lang", "source")
    rows = F.array(F.array(F.lit("id"), F.lit("a|b")), F.array(F.col("doc_id").cast("string"), F.concat(F.lit(" "), F.coalesce("source", F.lit("")), F.lit(" "))))
    style = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Heading "), (F.col("doc_id") % 4 + 1).cast("string"))).when(F.col("doc_id") % 3 == 1, "Heading").otherwise("Normal")
    return docs.select("doc_id", md.table_markdown(rows).alias("table_md"), md.heading(style, F.coalesce("lang", F.lit("none"))).alias("heading_md"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """T5, O2: paragraphs sorted by height and joined."""
    docs = text_table(spark, d, "documents").select("doc_id", "text")
    parts = F.transform(F.split("text", "\n\n", -1), lambda t, i: F.struct(((i * 7) % 5).cast("double").alias("y0"), i.alias("seq"), t.alias("text")))
    return docs.select("doc_id", F.md5(md.join_blocks(parts)).alias("joined_md5"))


def page_text(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each document, numbered, and their text joined again."""
    docs = text_table(spark, d, "documents").select("doc_id", "text")
    pages = sections.pages_of(docs, F.split("text", "\n\n", -1), "doc_id")
    return pages.groupBy("doc_id").agg(F.max("page_num").cast("long").alias("pages"), F.sum(F.length("page_text")).cast("long").alias("chars"))


def split_sections(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each path split into sections at every page with number 1 modulo 5."""
    pages = text_table(spark, d, "extracted_pages").select("page_id", "path", "page_num", "page_text").distinct()
    marked = pages.select("path", F.struct("page_num", "page_id").alias("pos"), F.coalesce("page_text", F.lit("")).alias("text"), (F.col("page_num") % 5 == 1).alias("has_break"))
    found = sections.split_sections(marked)
    return found.groupBy("path").agg(F.count("*").alias("sections"), F.sum(F.length("text")).cast("long").alias("chars"))


def reported(spark: SparkSession, d: str) -> DataFrame:
    """Newest stored metrics of each document beside its score now."""
    from leafmill.operators.listing import latest

    old = latest(table(spark, d, "quality_metrics").select("doc_id", "scored_at", "total_score"), "doc_id", "scored_at")
    now = tq.with_quality(text_table(spark, d, "documents").select("doc_id", "text"), "text", "now_")
    delta = F.round(F.col("now_total_score") - F.col("total_score"), 6)
    return now.join(old, "doc_id", "left").select("doc_id", delta.alias("delta"), tq.delta_class(delta).alias("change"))


_DOCS = "(SELECT doc_id AS id, text AS t FROM documents)"
_STRIP = r"regexp_replace({0}, '^[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+|[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+$', '', 'g')"


def _stripped_sql(text: str) -> str:
    s = _STRIP.format("l")
    return (
        f"array_to_string(list_filter(string_split({text}, chr(10)), lambda l: NOT (starts_with({s}, '#') OR starts_with({s}, '>') "
        f"OR {s} = '---' OR (starts_with({s}, '*Page') AND ends_with({s}, '*')))), chr(10))"
    )


_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_STEM = f"CASE WHEN regexp_full_match({_NAME}, '.+\\.[^.]+') THEN regexp_extract({_NAME}, '^(.+)\\.[^.]+$', 1) ELSE {_NAME} END"
_SUFFIX = f"lower(regexp_extract({_NAME}, '^.+(\\.[^.]+)$', 1))"
_LABEL = f"CASE WHEN {_SUFFIX} = '.pdf' THEN 'Page' ELSE 'Section' END"
_HEAD = f"'# ' || ({_STEM}) || chr(10) || chr(10) || '> Source: ' || path || chr(10) || chr(10) || '---' || chr(10) || chr(10)"
_BREAK = f"chr(10) || '---' || chr(10) || '*' || ({_LABEL}) || ' '"
_DAMAGED = f"""(({_HEAD}) || array_to_string(list_transform(list_transform(string_split(text, chr(10) || chr(10)), lambda p, i: CASE WHEN i % 3 = 2 THEN translate(p, 'aeo', '4€0') ELSE p END),
  lambda p, i: CASE WHEN i = 1 THEN p ELSE {_BREAK} || i || '*' || chr(10) || p END), chr(10)))"""

QUERIES = {
    "ref_a1_quality": quality, "ref_a1_page_quality": page_quality, "ref_p9_useful": useful, "ref_j3_improve": improve,
    "ref_t2_markdown": markdown, "ref_t2_markdown_parts": markdown_parts, "ref_t1_strip": stripped, "ref_t6_words": words,
    "ref_p1_p16_t3_paths": paths, "ref_t7_t8_tables": tables, "ref_t5_o2_blocks": blocks, "ref_n1_t4_pages": page_text,
    "ref_n7_sections": split_sections, "ref_a1_reported": reported,
}
SQL = {
    "ref_a1_quality": f"WITH {quality_ctes(_DOCS)} SELECT id AS doc_id, {_SQL_METRICS} FROM q",
    "ref_a1_page_quality": f"""WITH u AS (SELECT DISTINCT page_id, engine, page_text FROM extracted_pages), {quality_ctes("(SELECT page_id || '/' || coalesce(engine, '') AS id, page_text AS t FROM u)")}
      SELECT e.engine, count(*) AS pages, round(avg(q.total), 6) AS avg_score, CAST(sum(q.word_count) AS BIGINT) AS words
      FROM q JOIN (SELECT DISTINCT page_id || '/' || coalesce(engine, '') AS id, engine FROM u) e ON q.id = e.id GROUP BY e.engine""",
    "ref_p9_useful": f"""WITH {quality_ctes("(SELECT lang AS id, text AS t FROM documents)")}
      SELECT id AS lang, count(*) AS docs, CAST(sum(CASE WHEN total > 0.2 AND r > 0.2 THEN 1 ELSE 0 END) AS BIGINT) AS useful, round(avg(total), 6) AS avg_score FROM q GROUP BY id""",
    "ref_j3_improve": f"""WITH src AS (SELECT doc_id, {_stripped_sql(_DAMAGED)} AS o, {_stripped_sql("text")} AS n FROM documents),
      {quality_ctes("(SELECT doc_id AS id, o AS t FROM src)", "qo")}, {quality_ctes("(SELECT doc_id AS id, n AS t FROM src)", "qn")}
      SELECT qo.id AS doc_id, round(qo.total, 6) AS old_score, round(qn.total, 6) AS new_score, qn.total > qo.total AS better,
        CASE WHEN round(qn.total - qo.total, 9) > 0.02::DOUBLE THEN 'improved' WHEN round(qn.total - qo.total, 9) < -0.02::DOUBLE THEN 'regressed' WHEN qn.total IS NOT NULL AND qo.total IS NOT NULL THEN 'unchanged' END AS change
      FROM qo JOIN qn ON qo.id = qn.id""",
    "ref_t2_markdown": f"""SELECT doc_id, ({_HEAD}) || array_to_string(list_transform(string_split(text, chr(10) || chr(10)), lambda p, i: CASE WHEN i = 1 THEN p ELSE {_BREAK} || i || '*' || chr(10) || p END), chr(10)) AS markdown,
      CASE WHEN ({_SUFFIX}) <> '' THEN regexp_replace(path, '\\.[^./]+$', '.md') ELSE path || '.md' END AS output_path FROM documents WHERE path IS NOT NULL""",
    "ref_t2_markdown_parts": f"""SELECT page_id, md5(CASE WHEN page_num = 1 THEN ({_HEAD}) ELSE {_BREAK} || page_num || '*' || chr(10) END || coalesce(page_text, '')) AS part_md5
      FROM (SELECT DISTINCT page_id, path, page_num, page_text FROM extracted_pages)""",
    "ref_t1_strip": f"SELECT doc_id, md5({_stripped_sql('text')}) AS body_md5 FROM documents",
    "ref_t6_words": r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+'), lambda w: w <> '')) AS INTEGER) AS words, CAST(length(text) AS INTEGER) AS chars FROM documents",
    "ref_p1_p16_t3_paths": f"""SELECT path, path AS converted, CASE WHEN length(path) <= 20 THEN path ELSE '...' || right(path, 17) END AS short,
      {_STEM} AS stem, {_SUFFIX} AS suffix, {_LABEL} AS label FROM (SELECT DISTINCT path FROM file_listing)""",
    "ref_t7_t8_tables": f"""SELECT doc_id, '| id | a\\|b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' | ' || {_STRIP.format("replace(coalesce(source, ''), '|', chr(92) || '|')")} || ' |' AS table_md,
      CASE doc_id % 3 WHEN 0 THEN repeat('#', CAST(doc_id % 4 + 1 AS INTEGER)) || ' ' WHEN 1 THEN '# ' ELSE '' END || coalesce(lang, 'none') AS heading_md FROM documents""",
    "ref_t5_o2_blocks": f"""WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS t, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS i FROM documents),
      s AS (SELECT doc_id, i, {_STRIP.format("t")} AS t FROM b)
      SELECT d.doc_id, md5(coalesce(string_agg(s.t, chr(10) || chr(10) ORDER BY (s.i * 7) % 5, s.i), '')) AS joined_md5 FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id AND s.t <> '' GROUP BY d.doc_id""",
    "ref_n1_t4_pages": """SELECT doc_id, CAST(len(string_split(text, chr(10) || chr(10))) AS BIGINT) AS pages, CAST(length(replace(text, chr(10) || chr(10), '')) AS BIGINT) AS chars FROM documents""",
    "ref_n7_sections": """WITH u AS (SELECT DISTINCT page_id, path, page_num, page_text FROM extracted_pages),
      m AS (SELECT path, page_num, page_id, coalesce(page_text, '') AS t, sum(CASE WHEN page_num % 5 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY page_num, page_id ROWS UNBOUNDED PRECEDING) AS b FROM u),
      s AS (SELECT path, b, string_agg(t, chr(10) ORDER BY page_num, page_id) FILTER (t <> '') AS t FROM m GROUP BY path, b)
      SELECT path, CAST(greatest(count(t), 1) AS BIGINT) AS sections, CAST(coalesce(sum(length(t)), 0) AS BIGINT) AS chars FROM s GROUP BY path""",
    "ref_a1_reported": f"""WITH {quality_ctes(_DOCS)}, o AS (SELECT doc_id, max({{'a': scored_at, 'b': total_score}}) AS m FROM quality_metrics GROUP BY doc_id)
      SELECT q.id AS doc_id, round(q.total - o.m.b, 6) AS delta, CASE WHEN round(q.total - o.m.b, 6) > 0.02::DOUBLE THEN 'improved' WHEN round(q.total - o.m.b, 6) < -0.02::DOUBLE THEN 'regressed' WHEN o.m.b IS NOT NULL AND q.total IS NOT NULL THEN 'unchanged' END AS change
      FROM q LEFT JOIN o ON q.id = o.doc_id""",
}
