"""Sinks: upserts and deletes on partitioned Parquet, replace-by-key, bounded logs, JSON documents, manifests."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """stored with the last new row of each key in its place: new carries `order`, which is dropped."""
    rest = [c for c in stored.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("m")).select(*keys, *(F.col(f"m.{c}").alias(c) for c in rest))
    return stored.join(last, keys, "left_anti").unionByName(last.select(stored.columns))


def replace_by_key(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of stored whose key new doesn't have, and all of new."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def write_partitions(rows: DataFrame, path: str, by: str = "namespace") -> None:
    """Overwrite only the partitions that rows has; readers of others are not disturbed."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def _spark_path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _staging(path: str) -> str:
    """A folder beside the table that no other writer has."""
    return f"{path.rstrip('/')}__staged-{uuid.uuid4().hex}"


def upsert_partitions(spark: SparkSession, new: DataFrame, path: str, keys: list[str], order: str, by: str = "namespace") -> None:
    """Upsert into partitioned Parquet: the touched partitions are read, merged, staged beside and put in place."""
    target, files = _spark_path(spark, path)
    if not files.exists(target):
        write_partitions(upsert(spark.createDataFrame([], new.drop(order).schema), new, keys, order), path, by)
        return
    touched = new.select(by).distinct()
    old = spark.read.parquet(path).join(touched, by, "left_semi").select(new.drop(order).columns)
    staged = _staging(path)
    upsert(old, new, keys, order).write.mode("overwrite").parquet(staged)
    write_partitions(spark.read.parquet(staged), path, by)
    _spark_path(spark, staged)[1].delete(_spark_path(spark, staged)[0], True)


def delete_document(spark: SparkSession, path: str, namespace: str, document: str) -> None:
    """Rewrite one namespace's partition without a document."""
    kept = spark.read.parquet(path).where((F.col("namespace") == namespace) & (F.col("document_name") != document))
    staged = _staging(path)
    kept.write.mode("overwrite").parquet(staged)
    rows = spark.read.parquet(staged)
    if rows.isEmpty():
        reset_namespace(spark, path, namespace)
    else:
        write_partitions(rows, path)
    _spark_path(spark, staged)[1].delete(_spark_path(spark, staged)[0], True)


def reset_namespace(spark: SparkSession, path: str, namespace: str) -> None:
    """Drop one namespace's partition."""
    target, files = _spark_path(spark, f"{path.rstrip('/')}/namespace={namespace}")
    files.delete(target, True)


def check_vectors(rows: DataFrame, width: int, vector_col: str = "embedding") -> DataFrame:
    """Rows as they are; a vector of another width fails the job that reads them."""
    wrong = F.coalesce(F.size(vector_col), F.lit(-1)) != width
    return rows.where(F.when(wrong, F.raise_error(F.lit(f"a vector is not {width} wide"))).otherwise(F.lit(True)).cast("boolean"))


def keep_newest(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The newest n rows of a log."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(n)


def latest_state(events: DataFrame, key: str, order: str) -> DataFrame:
    """For each key the last non-null value of every column, as updates that leave nulls alone would give."""
    rest = [c for c in events.columns if c not in (key, order)]
    return events.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest), F.max(order).alias(order))


def documents_as_json(chunks: DataFrame, fields: list[str], order: list[str]) -> DataFrame:
    """One JSON document for each document_name with its chunks in order: document_name, n_chunks, json."""
    rows = chunks.groupBy("document_name").agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*fields).alias("chunk")))).alias("x"))
    body = F.transform("x", lambda s: s["chunk"])
    return rows.select("document_name", F.size("x").alias("n_chunks"), F.to_json(F.struct("document_name", body.alias("chunks"))).alias("json"))


def write_manifest(spark: SparkSession, manifest: dict, path: str) -> None:
    """Write a manifest, sorted JSON, as the last step of an ingestion: it is the mark that the data are complete."""
    target, files = _spark_path(spark, path)
    out = files.create(target, True)
    try:
        out.write(bytearray(json.dumps(manifest, sort_keys=True, ensure_ascii=False, indent=2).encode()))
    finally:
        out.close()


def review_issues(cases: DataFrame, sources: DataFrame) -> DataFrame:
    """Problems of gold cases, a row for each: case_id, issue (13 codes), detail.

    cases: pos (place in the file), case_id, query, query_variants, language,
    expect_evidence, reference_answers, required_claims, relevant_items
    (source_id, relevance_grade), review (status, reviewer_role, reviewed_at);
    sources: source_id, source_url.  Of ids and questions that repeat, all but
    the first are problems.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    none = lambda c: F.coalesce(F.size(c), F.lit(-1)) <= 0
    nth = F.row_number().over(Window.partitionBy("case_id").orderBy("pos"))
    rows = cases.withColumn("__nth", nth)
    reviewed = F.coalesce(F.col("review.status") == "reviewed", F.lit(False))
    asked = reviewed & F.coalesce("expect_evidence", F.lit(False))
    arabic = F.exists(F.coalesce("reference_answers", F.array().cast("array<string>")), lambda a: a.rlike("[\u0600-\u06ff]"))
    wrong = F.when((F.col("language") == "ar") & ~arabic, "Arabic case has no Arabic reference answer").when((F.col("language") == "en") & arabic, "English case contains an Arabic reference answer")
    issue = lambda when, code, detail="": F.when(when, F.struct(F.lit(code).alias("issue"), F.coalesce(F.lit(detail) if isinstance(detail, str) else detail, F.lit("")).alias("detail")))
    own = F.array(
        issue((text(F.col("case_id")) == "") | (F.col("__nth") > 1), "duplicate_or_missing_case_id", F.coalesce(F.nullif("case_id", F.lit("")), F.lit("missing"))),
        issue(~text(F.col("language")).isin("en", "ar"), "invalid_language", F.coalesce("language", F.lit("None"))),
        issue(~reviewed, "pending_human_review", F.coalesce("review.reviewer_role", F.lit("reviewer_role_required"))),
        issue(reviewed & (text(F.col("review.reviewed_at").cast("string")) == ""), "reviewed_case_missing_timestamp"),
        issue(asked & none("reference_answers"), "missing_language_reference_answer"),
        issue(asked & ~none("reference_answers") & wrong.isNotNull(), "reference_language_content_mismatch", wrong),
        issue(asked & none("required_claims"), "missing_required_claims"),
        issue(asked & none("relevant_items"), "missing_relevance_judgments"),
    )
    out = rows.select("case_id", F.explode(F.array_compact(own)).alias("p")).select("case_id", "p.issue", "p.detail")
    questions = F.concat(F.array(text(F.col("query"))), F.coalesce("query_variants", F.array().cast("array<string>")))
    said = rows.select("case_id", "pos", F.posexplode(questions).alias("i", "detail")).withColumn("said", T.normalize_words(F.col("detail")))
    again = said.withColumn("__n", F.row_number().over(Window.partitionBy("said").orderBy("pos", "i")))
    kind = F.when(F.col("said") == "", "empty_query_or_variant").when(F.col("__n") > 1, "duplicate_query_or_variant")
    out = out.unionByName(again.select("case_id", kind.alias("issue"), F.when(F.col("said") == "", "").otherwise(F.col("detail")).alias("detail")).where("issue is not null"))
    known = sources.groupBy(F.col("source_id").alias("__id")).agg(F.min("source_url").alias("url"))
    items = rows.select("case_id", F.explode("relevant_items").alias("item")).select("case_id", text(F.col("item.source_id")).alias("source"), F.col("item.relevance_grade").alias("grade"))
    met = items.join(known, F.col("source") == F.col("__id"), "left")
    codes = F.array(
        issue(F.col("__id").isNull(), "unknown_source_id", F.col("source")),
        issue(F.col("__id").isNotNull() & ~F.startswith(text(F.col("url")), F.lit("https://")), "non_https_provenance", F.col("source")),
        issue(F.col("grade").isNull() | (F.col("grade") <= 0), "invalid_relevance_grade", F.coalesce(F.col("grade").cast("string"), F.lit("None"))),
    )
    return out.unionByName(met.select("case_id", F.explode(F.array_compact(codes)).alias("p")).select("case_id", "p.issue", "p.detail"))


def ingest_certified(spark: SparkSession, chunks: DataFrame, path: str, namespace: str, manifest: dict) -> dict:
    """Write a corpus to a namespace of its own and its manifest last, so that a reader who sees the manifest sees all of it.

    Fails if the manifest exists already or there are no chunks; a namespace
    without a manifest is what an interrupted run left, and is replaced.
    """
    mark = f"{path.rstrip('/')}/_manifests/{namespace}.json"
    target, files = _spark_path(spark, mark)
    if files.exists(target):
        raise ValueError(f"namespace {namespace} is complete already")
    rows = chunks.withColumn("namespace", F.lit(namespace))
    write_partitions(rows, path)
    back = spark.read.parquet(path).where(F.col("namespace") == namespace)
    n, documents = back.agg(F.count("*"), F.countDistinct("document_name")).first()
    if not n:
        raise ValueError("no chunks to ingest")
    done = {**manifest, "namespace": namespace, "chunk_count": n, "document_count": documents}
    write_manifest(spark, done, mark)
    return done
