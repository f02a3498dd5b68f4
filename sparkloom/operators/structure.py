"""Structural transforms of documents: filling titles, merging pages, numbering chunks, dropping running lines.

Lists carry an explicit index column, since rows have no order of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import classify as C
from sparkloom.functions import text as T
from sparkloom.functions.chunking import chunk_column
from sparkloom.sources.workspace import written


def fill_titles(elements: DataFrame) -> DataFrame:
    """Headings hand their section and subsection down to the following elements of the document that have none.

    A heading with a section resets the subsection, then applies its own.
    """
    order = Window.partitionBy("document_name").orderBy("elem_idx")
    head = F.col("content_type") == "heading"
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    rows = elements.withColumn("__group", F.sum((head & has("section_title")).cast("int")).over(order))
    section = F.last(F.when(head & has("section_title"), F.col("section_title")), ignorenulls=True).over(order)
    sub = F.last(F.when(head & has("subsection_title"), F.col("subsection_title")), ignorenulls=True).over(Window.partitionBy("document_name", "__group").orderBy("elem_idx"))
    fill = lambda c, v: F.when(head | has(c), F.coalesce(F.col(c), F.lit(""))).otherwise(F.coalesce(v, F.lit("")))
    return rows.withColumns({"section_title": fill("section_title", section), "subsection_title": fill("subsection_title", sub)}).drop("__group")


def merge_units(elements: DataFrame) -> DataFrame:
    """Elements of one page become one unit of text, tables units of their own.

    A unit stands where its first element stood and takes the first title that
    is not blank; a heading that others join becomes text.
    """
    table = F.col("content_type") == "table"
    rows = elements.where(T.clean_content(F.coalesce("content", F.lit(""))) != "").withColumn("content", T.clean_content(F.col("content")))
    key = F.when(table, F.col("elem_idx")).otherwise(-1)
    item = F.struct("elem_idx", "content", "section_title", "subsection_title", "content_type")
    grouped = rows.groupBy("document_name", "page_number", key.alias("__table")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    first_title = lambda c: F.coalesce(F.get(F.filter(F.transform("items", lambda x: x[c]), lambda t: F.coalesce(t, F.lit("")) != ""), F.lit(0)), F.lit(""))
    kinds = F.transform("items", lambda x: x["content_type"])
    first = F.get("items", F.lit(0))
    kind = F.when((first["content_type"] == "heading") & F.exists(kinds, lambda k: k != "heading"), "text").otherwise(first["content_type"])
    return grouped.select(
        "document_name", "page_number", first["elem_idx"].alias("unit_idx"), first_title("section_title").alias("section_title"),
        first_title("subsection_title").alias("subsection_title"), kind.alias("content_type"), F.array_join(F.transform("items", lambda x: x["content"]), "\n\n").alias("content"),
    )


def number_chunks(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Adds chunk_index, from 0 within each document, and chunk_id."""
    at = F.row_number().over(Window.partitionBy("document_name").orderBy(*order)) - 1
    return chunks.withColumn("chunk_index", at).withColumn("chunk_id", T.chunk_id(F.col("document_name"), F.col("page_number"), F.col("chunk_index")))


def chunk_elements(elements: DataFrame, size: int = 2000, overlap: int = 200, least: int = 100, min_score: float = 0.1, priors: dict[str, str] | None = None, profile: str = "") -> DataFrame:
    """Elements to chunk records: titles filled, pages merged, split, scored, classified, numbered."""
    units = merge_units(fill_titles(elements))
    pieces = units.select("*", F.posexplode(chunk_column(F.col("content"), size=size, overlap=overlap, least=least)).alias("pos", "chunk"))
    kept = pieces.withColumn("quality_score", T.core_score(F.col("chunk"))).where(F.col("quality_score") >= min_score)
    prior = C.document_category(F.col("document_name"), priors or {})
    titles = F.concat_ws(" ", "section_title", "subsection_title")
    numbered = number_chunks(kept.withColumn("category", C.classify_chunk(titles, F.col("chunk"), prior)), ["unit_idx", "pos"])
    return numbered.select(
        "chunk_id", "document_name", "page_number", "section_title", "subsection_title", "category", "content_type", T.script_language(F.col("chunk")).alias("language"), F.col("chunk").alias("text"),
        F.length("chunk").alias("char_count"), T.word_count(F.col("chunk")).cast("int").alias("word_count"), F.round("quality_score", 4).alias("quality_score"), F.lit(profile).alias("chunk_profile"),
    )


def page_records(chunks: DataFrame) -> DataFrame:
    """Records of scored chunks (document_name, page_number, pos, text, quality_score, language): index runs on over a document's pages."""
    order = Window.partitionBy("document_name").orderBy("page_number", "pos")
    return chunks.select(
        "document_name", (F.row_number().over(order) - 1).cast("long").alias("index"), "page_number", "text", F.length("text").cast("long").alias("char_count"), T.word_count(F.col("text")).alias("word_count"), "quality_score", "language",
    )


def drop_repeated_lines(pages: DataFrame, max_line: int = 100) -> DataFrame:
    """Lines that many pages of a document share go: (document_name, page_number, text, exact_removed, marker_removed).

    Documents of fewer than 3 pages stay as they are.  Lines equal on half of the
    pages (3 at least) are running headers; lines equal on a quarter of them
    (3 at least) once their page marker is off are running footers, which are
    also cut out where they are glued to other text, if 15 characters or longer.
    """
    lines = pages.select("document_name", "page_number", F.posexplode(F.split("text", "\n")).alias("at", "raw")).withColumn("line", T.strip(F.col("raw")))
    lines = written(lines.withColumn("base", T.page_marker_base(F.col("line"))), "page-lines")  # three branches read them
    count = pages.groupBy("document_name").agg(F.count("*").alias("n"))
    # `set(lines)` of a page is over lines as they stand: a line that differs in white space only counts once for each form
    seen = lines.where((F.col("line") != "") & (F.length("line") <= max_line)).select("document_name", "page_number", "raw", "line", "base").distinct()
    exact = seen.groupBy("document_name", "line").agg(F.count("*").alias("c")).join(count, "document_name").where((F.col("n") >= 3) & (F.col("c") >= F.greatest(F.lit(3), F.floor(F.col("n") * 0.5))))
    marked = seen.where(F.coalesce("base", F.lit("")) != "").groupBy("document_name", "base").agg(F.count("*").alias("c")).join(count, "document_name")
    marked = marked.where((F.col("n") >= 3) & (F.col("c") >= F.greatest(F.lit(3), F.floor(F.col("n") * 0.25))))
    quoted = F.regexp_replace(F.col("base"), r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    footer = F.concat(quoted, F.lit(r"(?U)\s*(?:[|·•\-–—]\s*[0-9IVXLCDM]{1,5})?"))
    footers = marked.where(F.length("base") >= 15).groupBy("document_name").agg(F.sort_array(F.collect_list(F.struct(footer.alias("pattern"), "base"))).alias("footers"))
    touched = exact.select("document_name").union(marked.select("document_name")).distinct().withColumn("touched", F.lit(True))
    met = (
        lines.join(exact.select("document_name", "line", F.lit(True).alias("is_exact")), ["document_name", "line"], "left")
        .join(marked.select("document_name", "base", F.lit(True).alias("is_marked")), ["document_name", "base"], "left")
        .join(footers, "document_name", "left")
        .join(touched, "document_name", "left")
    )
    # a pattern is only compiled for a line that holds its base; a column of its own, since it is read more than once
    cut = F.aggregate("footers", F.col("line"), lambda a, p: F.when(F.contains(a, p["base"]), T.strip(F.regexp_replace(a, p["pattern"], F.lit("")))).otherwise(a))
    met = met.withColumn("cut", F.coalesce(cut, "line"))
    gone = F.coalesce("is_exact", F.lit(False)) | F.coalesce("is_marked", F.lit(False))
    new = F.when(F.col("touched").isNull(), F.col("raw")).when(gone, None).otherwise(F.col("cut"))
    glued = F.col("touched").isNotNull() & ~gone & (new != F.col("line"))
    kept = F.struct("at", new.alias("new"))
    return met.groupBy("document_name", "page_number").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(new.isNotNull() & (F.col("touched").isNull() | (new != "")), kept))), lambda x: x["new"]), "\n").alias("text"),
        F.count_if(F.col("is_exact")).alias("exact_removed"),
        F.count_if((F.col("is_marked") & F.col("is_exact").isNull()) | glued).alias("marker_removed"),
    )


def clean_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cleaned pages that are not empty, and one row of statistics for each document."""
    base = T.dehyphenate(T.normalize(F.col("text")))
    even = pages.select("document_name", "page_number", "text").repartition("document_name", "page_number")  # numbered pages of a large document lie in one partition
    once = even.select("document_name", "page_number", base.alias("base"), F.length("text").alias("before"))
    single = once.select("document_name", "page_number", T.collapse_blank_lines(T.drop_page_numbers(F.col("base"))).alias("text"), T.count_page_numbers(F.col("base")).alias("numbers"), "before")
    single = written(single, "single-pages")
    cleaned = drop_repeated_lines(single).withColumn("text", T.strip_lines(F.col("text")))
    stats = single.join(cleaned.withColumnRenamed("text", "after"), ["document_name", "page_number"]).groupBy("document_name").agg(
        F.count("*").alias("pages_before"), F.count_if(F.col("after") != "").alias("pages_after"), F.sum("before").alias("chars_before"), F.sum(F.length("after")).alias("chars_after"),
        F.sum("numbers").alias("page_number_lines_removed"), F.sum("exact_removed").alias("repeated_boilerplate_lines_removed"), F.sum("marker_removed").alias("footer_lines_removed"),
    )
    return cleaned.where("text <> ''").select("document_name", "page_number", "text"), stats
