"""Layout rules of page spans: body size, headings, sections, blocks that tables cover.

Spans (document_name, page_number, block, line, span, x0, y0, x1, y1 of the
block, size, bold, text) come from whatever reads page files; the rules are
plain aggregations, so any reader can feed them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def body_sizes(spans: DataFrame) -> DataFrame:
    """Most frequent rounded size of each page; ties go to the smaller."""
    n = spans.groupBy("document_name", "page_number", F.round("size").alias("r")).agg(F.count("*").alias("n"))
    return n.groupBy("document_name", "page_number").agg(F.min(F.struct((-F.col("n")).alias("n"), "r")).alias("m")).select("document_name", "page_number", F.col("m.r").alias("body"))


def outside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks of which no table of the page (x0, y0, x1, y1) covers more than half."""
    page = ["document_name", "page_number"]
    t = tables.select(*page, *(F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")))
    side = lambda a, b: F.greatest(F.lit(0.0), F.least(F.col(f"{b}1"), F.col(f"t_{b}1")) - F.greatest(F.col(f"{a}0"), F.col(f"t_{a}0")))
    area = F.greatest(F.lit(1.0), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    covered = blocks.join(t, page).where(side("x", "x") * side("y", "y") / area > 0.5).select(*page, "block").distinct()
    return blocks.join(covered, [*page, "block"], "left_anti")


def elements(spans: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Blocks as document elements in reading order (page, then height): headings are bold or 1.15 times the body's size.

    Headings of 1.4 times the body's size name a section, others a subsection;
    the titles are carried down by `structure.fill_titles`.
    """
    page = ["document_name", "page_number"]
    said = spans.where(F.trim("text") != "").join(body_sizes(spans), page)
    heading = F.col("bold") | (F.col("size") >= F.col("body") * 1.15)
    line = said.groupBy(*page, "block", "line", "body").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("span", F.trim("text").alias("t")))), lambda s: s["t"]), " ").alias("t"),
        F.max(F.when(heading, F.struct("line", "span", "size"))).alias("head"), *(F.first(c).alias(c) for c in ("x0", "y0", "x1", "y1")),
    )
    block = line.groupBy(*page, "block", "body").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "t"))), lambda s: s["t"]), "\n").alias("content"), F.max("head").alias("head"), *(F.first(c).alias(c) for c in ("x0", "y0", "x1", "y1"))
    )
    block = outside_tables(block, tables) if tables is not None else block
    is_head, large = F.col("head").isNotNull(), F.col("head.size") >= F.col("body") * 1.4
    title = F.substring("content", 1, 200)
    order = F.struct("page_number", "y0", "block")
    rows = block.select(
        "document_name", "page_number", "y0", "block", F.when(is_head & large, title).otherwise("").alias("section_title"), F.when(is_head & ~large, title).otherwise("").alias("subsection_title"),
        "content", F.when(is_head, "heading").otherwise("text").alias("content_type"), order.alias("__order"),
    )
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("document_name").orderBy("__order")) - 1
    return rows.withColumn("elem_idx", at.cast("long")).drop("__order", "y0", "block")
