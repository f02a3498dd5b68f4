"""Sources: text, JSON, CSV and binary files as document elements and catalogs."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.sources.docx import parse_docx

ELEMENT = "document_name string, elem_idx long, page_number int, section_title string, subsection_title string, content string, content_type string"
CATALOG = "source_id string, document_name string, source_url string, publisher string, publication_date string, license_note string, reuse_status string, checksum string, enabled boolean"

#: Parsers of binary formats by extension: (name, bytes) -> rows of (page, section, subsection, content, type). PDF needs a library that may be absent.
PARSERS: dict[str, Callable[[str, bytes], Iterator[tuple]]] = {"docx": parse_docx}


def register_parser(extension: str, parser: Callable[[str, bytes], Iterator[tuple]]) -> None:
    PARSERS[extension.lower().lstrip(".")] = parser


def list_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("pdf", "docx", "txt")) -> DataFrame:
    """Files below a folder with one of the extensions: path, length, content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*extensions))


def read_text_elements(spark: SparkSession, path: str) -> DataFrame:
    """Plain text files as elements: blocks between blank lines, page 1."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1).alias("document_name"), "value")
    return text_elements(files)


def text_elements(files: DataFrame) -> DataFrame:
    """(document_name, value) as elements."""
    blocks = files.select("document_name", F.posexplode(F.split("value", r"\n{2,}")).alias("elem_idx", "content")).withColumn("content", T.strip(F.col("content"))).where("content <> ''")
    return blocks.select("document_name", F.col("elem_idx").cast("long").alias("elem_idx"), F.lit(1).alias("page_number"), F.lit("").alias("section_title"), F.lit("").alias("subsection_title"), "content", F.lit("text").alias("content_type"))


def _decode(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def parse_files(files: DataFrame) -> DataFrame:
    """Files (path, content) as elements by extension. A registered parser gets one file at a time; files without one, or that it fails on, give no rows here and a row in `parse_outcomes`."""
    parsers = dict(PARSERS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, raw in zip(f["path"], f["content"]):
                name = path.rsplit("/", 1)[-1]
                kind = name.rsplit(".", 1)[-1].lower()
                if kind in parsers:
                    found, _ = _parsed(parsers[kind], name, bytes(raw))
                    rows += [(name, i, *x) for i, x in enumerate(found)]
                elif kind == "txt":
                    blocks = [b.strip() for b in re.split(r"\n{2,}", _decode(bytes(raw)))]
                    rows += [(name, i, 1, "", "", b, "text") for i, b in enumerate(b for b in blocks if b)]
            yield pd.DataFrame(rows, columns=["document_name", "elem_idx", "page_number", "section_title", "subsection_title", "content", "content_type"])

    return files.select("path", "content").mapInPandas(run, ELEMENT)


def _parsed(parser: Callable[[str, bytes], Iterator[tuple]], name: str, raw: bytes) -> tuple[list[tuple], str]:
    """A parser's rows, and its error: files come from outside, and a broken one must not end the job."""
    try:
        return list(parser(name, raw)), ""
    except Exception as e:
        return [], f"{type(e).__name__}: {e}"[:200]


def parse_outcomes(files: DataFrame) -> DataFrame:
    """One row for each file (path, content): document_name, outcome (parsed, unsupported, failed), elements, error."""
    parsers = dict(PARSERS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, raw in zip(f["path"], f["content"]):
                name = path.rsplit("/", 1)[-1]
                kind = name.rsplit(".", 1)[-1].lower()
                if kind == "txt":
                    rows.append((name, "parsed", sum(bool(b.strip()) for b in re.split(r"\n{2,}", _decode(bytes(raw)))), ""))
                elif kind in parsers:
                    found, error = _parsed(parsers[kind], name, bytes(raw))
                    rows.append((name, "failed" if error else "parsed", len(found), error))
                else:
                    rows.append((name, "unsupported", 0, f"no parser for {kind}"))
            yield pd.DataFrame(rows, columns=["document_name", "outcome", "elements", "error"])

    return files.select("path", "content").mapInPandas(run, "document_name string, outcome string, elements long, error string")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Source catalog: a JSON file that lists entries under `sources`, or at the top."""
    raw = spark.read.text(path, wholetext=True).first()[0]
    data = json.loads(raw)
    rows = data.get("sources", []) if isinstance(data, dict) else data
    names = [c.split()[0] for c in CATALOG.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], CATALOG)


def catalog_issues(catalog: DataFrame) -> DataFrame:
    """Enabled entries that lack what provenance needs, and repeated documents or ids: source_id, issue."""
    on = catalog.where("enabled")
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    codes = F.array(
        F.when(~F.coalesce(F.col("source_url").startswith("https://"), F.lit(False)), "url"), *(F.when(blank(c), c) for c in ("publisher", "publication_date", "license_note", "reuse_status")),
        F.when(~F.coalesce(F.col("checksum").rlike("^[0-9a-f]{64}$"), F.lit(False)), "checksum"),
    )
    out = on.select("source_id", F.explode(F.array_compact(codes)).alias("issue"))
    for c in ("document_name", "source_id"):
        twice = on.groupBy(c).agg(F.count("*").alias("n"), F.min("source_id").alias("id")).where("n > 1")
        out = out.unionByName(twice.select(F.col("id").alias("source_id"), F.lit(f"duplicate {c}").alias("issue")))
    return out


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_traces(spark: SparkSession, path: str, schema: str, limit: int = 200, conversation: str | None = None) -> DataFrame:
    """The newest traces, oldest first."""
    rows = read_log(spark, path, schema)
    rows = rows.where(F.col("conversation_id") == conversation) if conversation else rows
    return rows.orderBy(F.desc("recorded_at")).limit(max(1, min(1000, limit))).orderBy("recorded_at")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """A manifest, or None if there is none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def gold_cases(raw: DataFrame) -> DataFrame:
    """Gold cases with defaults: canonical lists where they are missing, status from whether evidence is expected."""
    empty = F.array().cast("array<string>")
    return raw.withColumns({
        "query_variants": F.coalesce("query_variants", empty), "text_anchors": F.coalesce("text_anchors", empty), "reference_answers": F.coalesce("reference_answers", empty),
        "expected_status": F.coalesce("expected_status", F.when(F.col("expect_evidence"), "ready").otherwise("out_of_scope")),
    })


def sample_questions(raw: DataFrame) -> DataFrame:
    """Scenarios (scenario, en, ar: arrays of questions) as one row per question."""
    langs = F.array(F.struct(F.lit("en").alias("language"), F.col("en").alias("q")), F.struct(F.lit("ar").alias("language"), F.col("ar").alias("q")))
    return raw.select("scenario", F.explode(langs).alias("l")).select("scenario", "l.language", F.posexplode("l.q").alias("pos", "text"))
