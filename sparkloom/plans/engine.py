"""One object for an indexed corpus: what a service or a command line would call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import classify as C
from sparkloom.functions import text as T
from sparkloom.operators import answers, embedding, retrieval, structure, telemetry, vectors


class Engine:
    """chunks: chunk records with `embedding`; catalog: provenance of documents; embedder: the model of both."""

    def __init__(self, chunks: DataFrame, catalog: DataFrame, embedder: embedding.Embedder = embedding.hashed_words, manifest_hash: str = ""):
        self.chunks, self.catalog, self.embedder, self.manifest_hash = chunks, catalog, embedder, manifest_hash

    @classmethod
    def ingest(cls, elements: DataFrame, catalog: DataFrame, embedder: embedding.Embedder = embedding.hashed_words, **options) -> Engine:
        """From document elements: chunks, categories, provenance and vectors."""
        records = structure.chunk_elements(elements, **options)
        return cls(embedding.embed(retrieval.enrich(records, catalog), embedder), catalog, embedder)

    def retrieve(self, questions: DataFrame, k: int = 5, threshold: float = retrieval.THRESHOLD) -> DataFrame:
        """An evidence envelope for each question (query_id, query, history)."""
        return retrieval.stage_evidence(self.chunks, embedding.embed_queries(questions, self.embedder), self.catalog, k, threshold)

    def answer(self, questions: DataFrame, k: int = 5, threshold: float = retrieval.THRESHOLD) -> DataFrame:
        """query_id, status, answer: extractive bullets with citations and the note that the question's safety level asks for."""
        found = self.retrieve(questions, k, threshold)
        ready = found.where("status = 'ready'").select("query_id", F.explode("chunks").alias("c")).select("query_id", "c.rank", F.col("c.id").alias("chunk_id"))
        evidence = ready.join(self.chunks, "chunk_id").join(questions.select("query_id", "query"), "query_id")
        bullets = answers.extractive_bullets(evidence).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("n", "bullet"))).alias("b"))
        text = F.array_join(F.transform("b", lambda x: x["bullet"]), "\n\n")
        note = C.disclaimer(C.safety_level(F.col("query")), T.is_arabic(F.col("query")))
        met = found.select("query_id", "status").join(questions.select("query_id", "query"), "query_id").join(bullets, "query_id", "left")
        return met.select("query_id", "status", F.when(F.col("status") == "ready", F.concat(F.coalesce(text, F.lit("")), note)).alias("answer"))

    def rehydrate(self, requests: DataFrame) -> DataFrame:
        return retrieval.rehydrate(self.chunks, requests, self.catalog, self.manifest_hash)

    def audit(self, width: int) -> DataFrame:
        return vectors.width_audit(self.chunks, "document_name", width)

    def profiles(self, expected: int, accepted: list[int]) -> DataFrame:
        return telemetry.profile_catalog(self.chunks.withColumn("dimension", F.size("embedding")), expected, accepted)

    @staticmethod
    def metrics_report(traces: DataFrame) -> DataFrame:
        return telemetry.report(traces)

    @staticmethod
    def quota_dashboard(events: DataFrame, by: str, limits: dict[str, int]) -> DataFrame:
        """The latest usage of each key with utilisation and alert."""
        used = telemetry.rolling_usage(events, by)
        now = used.groupBy(by).agg(F.max_by(F.struct("rpm_used", "tpm_used", "rpd_used"), F.struct("ts", "event_id")).alias("u")).select(by, "u.*")
        return now.select(by, *telemetry.quota_snapshot({k: F.col(f"{k}_used") for k in limits}, limits))
