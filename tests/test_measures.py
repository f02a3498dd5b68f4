"""Percentiles, sketches, language profiles, canonical hashes, sinks that fail and bounded logs, against plain Python."""

from __future__ import annotations

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import langid, manifests, percentiles, retrieval
from sparkloom.sources import logs

PS = (0.0, 0.07, 0.5, 0.95, 0.99, 1.0)


def test_exact_percentiles_are_elements(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.5, rng.gauss(0, 9)])) for _ in range(3000)]
    rows += [("hot", 7.0)] * 2000 + [("one", 3.0), ("none", None), ("nan", float("nan")), ("nan", 1.0)]
    found = percentiles.exact(spark.createDataFrame(rows, "g string, v double").repartition(5), "v", PS, ["g"], parts=7)
    got = {(r.g, r.p): r.value for r in found.collect()}
    want = {}
    for g in {g for g, _ in rows}:
        values = sorted((v for h, v in rows if h == g and v is not None), key=lambda v: (math.isnan(v), v))
        want |= {(g, p): values[max(1, math.ceil(p * len(values))) - 1] for p in PS if values}
    assert got.keys() == want.keys()
    assert all(got[k] == want[k] or math.isnan(got[k]) and math.isnan(want[k]) for k in want)


def test_exact_percentiles_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert percentiles.exact(empty, "v", PS, ["g"]).collect() == []
    assert percentiles.columns(percentiles.exact(empty, "v", PS), PS).first().asDict() == {"p0": None, "p7": None, "p50": None, "p95": None, "p99": None, "p100": None}


def test_merged_sketches_answer_near_the_rank(spark):
    rows = spark.range(60_000).select((F.col("id") % 40).alias("day"), F.exp(F.randn(3) * 2).alias("v"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    values = sorted(r.v for r in rows.collect())
    kept = percentiles.sketches(rows, "v", ["day"])
    assert kept.agg(F.max(F.length("sketch"))).first()[0] < 40_000
    for r in percentiles.rolled_up(kept, PS).collect():
        below = sum(v <= r.value for v in values) / len(values)
        assert r.n == 60_000 and abs(below - r.p) < 0.01


STRINGS = ["", "plain", 'q"uo\\te', "tab\tnl\nret\rff\fbs\b", "\x00\x1f\x7f", "é ß م", "😀x", "\\u00e9", "/"]


def test_canonical_json_is_that_of_the_json_module(spark):
    rows = [(s, {s: 1, "Z": None, "a😀": 3}, [True, None], (i, STRINGS)) for i, s in enumerate(STRINGS)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "z string, m map<string, long>, `a b` array<boolean>, s struct<n: int, t: array<string>>")
    got = df.select("z", manifests.canonical_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), df.schema).alias("j")).collect()
    want = [{"z": z, "m": m, "a b": b, "s": s and {"n": s[0], "t": s[1]}} for z, m, b, s in rows]
    assert [r.j for r in got] == [json.dumps(w, sort_keys=True, separators=(",", ":")) for w in want]
    with pytest.raises(TypeError):
        manifests.canonical_json(F.lit(1.5), spark.range(1).select(F.lit(1.5)).schema[0].dataType)


def test_stale_indexes_stop_questions(spark):
    settings = {"dimension": 384, "chunk_profile": "large", "embedding_provider": "local", "embedding_model": "m", "source_catalog_hash": "c"}
    names = ["Own Index", "other", "hosted", "bare"]
    runtimes = spark.createDataFrame([(n, *settings.values(), n == "hosted") for n in names], "namespace string, dimension int, chunk_profile string, embedding_provider string, embedding_model string, source_catalog_hash string, hosted boolean")
    own = spark.createDataFrame([("own_index", *settings.values(), 7), ("other", 768, *list(settings.values())[1:], 7)], "namespace string, dimension int, chunk_profile string, embedding_provider string, embedding_model string, source_catalog_hash string, token_count long")
    active = manifests.active_hashes(runtimes, own)
    digest = lambda d: hashlib.sha256(json.dumps(d, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    mine = digest({"namespace": "own_index", **settings, "token_count": 7})
    assert {r.namespace: r.active_hash for r in active.collect()} == {"own_index": mine, "other": "", "hosted": digest({"namespace": "hosted", **settings}), "bare": ""}
    asked = spark.createDataFrame([(1, "Own-Index", None), (2, "own_index", mine), (3, "own_index", "before"), (4, "other", None), (5, "unknown", None), (6, None, None)], "query_id long, namespace string, index_hash string")
    stale = manifests.with_stale(asked, active)
    assert {r.query_id: r.stale for r in stale.collect()} == {1: False, 2: False, 3: True, 4: True, 5: True, 6: True}
    said = stale.withColumn("status", retrieval.gate_status(F.lit("what is type 2 diabetes treatment"), F.lit(True), F.array().cast("array<string>"), F.col("stale")))
    assert {r.query_id: r.status for r in said.collect()} == {1: None, 2: None, **dict.fromkeys((3, 4, 5, 6), "stale_index")}


def _stream(spark, folder):
    return spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).parquet(folder)


def test_a_failing_sink_holds_up_nobody_and_catches_up(spark, tmp_path):
    source, ledger = f"file://{tmp_path}/in", f"file://{tmp_path}/ledger"
    spark.range(30).withColumnRenamed("id", "k").repartition(3, "k").write.parquet(source)
    down = [True]

    def shaky(df, epoch):
        if down[0]:
            raise OSError("down")
        logs.epoch_writer(f"file://{tmp_path}/b")(df, epoch)

    sinks = {"a": logs.epoch_writer(f"file://{tmp_path}/a"), "b": shaky}
    logs.fan_out(_stream(spark, source), sinks, ledger, f"file://{tmp_path}/cp").awaitTermination()
    keys = lambda name: sorted(r.k for r in spark.read.parquet(f"file://{tmp_path}/{name}").collect())
    assert keys("a") == list(range(30)) and not (tmp_path / "b").exists()
    assert logs.deliver(spark, sinks, ledger) == {"a": [], "b": [0, 1, 2]}
    down[0] = False
    assert logs.deliver(spark, sinks, ledger) == {"a": [], "b": []}
    assert keys("b") == list(range(30))
    assert not list((tmp_path / "ledger" / "staged").glob("epoch=*"))


def test_an_epoch_that_comes_again_is_written_once(spark, tmp_path):
    source, ledger = f"file://{tmp_path}/in", f"file://{tmp_path}/ledger"
    spark.range(10).withColumnRenamed("id", "k").coalesce(1).write.parquet(source)
    calls = []
    sink = {"log": lambda df, epoch: calls.append((epoch, df.count()))}
    for checkpoint in ("one", "two"):  # a lost checkpoint: the epochs start anew
        logs.fan_out(_stream(spark, source), sink, ledger, f"file://{tmp_path}/{checkpoint}").awaitTermination()
    assert calls == [(0, 10)]


def test_a_bounded_log_keeps_the_newest(spark, tmp_path):
    path, rng = f"file://{tmp_path}/log", random.Random(2)
    assert logs.read_log(spark, path) is None
    said = []
    for _ in range(4):
        rows = [(rng.randrange(20), rng.randrange(10**6)) for _ in range(30)]
        logs.append_log(spark, path, spark.createDataFrame(rows, "ts int, v int"), ["ts"], 40)
        said = sorted(said + rows, reverse=True)[:40]
        assert sorted(map(tuple, logs.read_log(spark, path).collect()), reverse=True) == said
    assert len(list((tmp_path / "log").glob("version=*"))) == 2
    (tmp_path / "log" / ".staged-dead").mkdir()  # a writer that died
    assert logs.read_log(spark, path).count() == 40
    with pytest.raises(Exception, match="boom"):
        logs.append_log(spark, path, spark.createDataFrame([(99, 1)], "ts int, v int").withColumn("v", F.raise_error(F.lit("boom")).cast("int")), ["ts"], 40)
    assert logs.read_log(spark, path).where("ts = 99").count() == 0


def test_profiles_tell_languages_they_have_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    from sparkloom.functions import classify

    rest = docs.where(held).select("doc_id", "lang", "text")
    told = langid.accuracy(langid.identify(rest, langid.fit(docs.where(~held)))).agg(F.sum("n"), F.sum("right_n")).first()
    voted = langid.accuracy(rest.withColumn("language", classify.language(F.col("text")))).agg(F.sum("right_n")).first()
    print(told, voted)
    assert told[1] / told[0] >= 0.95 and told[1] >= voted[0]


def test_identification_of_odd_texts(spark):
    taught = spark.createDataFrame([("aa", "foo bar foo foo bar " * 5), ("bb", "quux zyz quux zyz " * 5), (None, "lost"), ("aa", None)], "lang string, text string")
    model = langid.fit(taught)
    odd = [(1, "foo bar foo bar foo bar"), (2, "zyz quux quux zyz zyz"), (3, None), (4, ""), (5, "foo"), (6, "1234 5678 9012 3456 7890 !!"), (7, "foo bar " * 200_000)]
    got = {r.id: r for r in langid.identify(spark.createDataFrame(odd, "id int, text string").withColumn("m", F.create_map(F.lit("k"), F.lit(1))), model).collect()}
    assert {i: r.language for i, r in got.items()} == {1: "aa", 2: "bb", 3: "en", 4: "en", 5: "en", 6: "en", 7: "aa"}
    assert got[1].probability > 0.9 and got[3].probability is None and got[1].m == {"k": 1}
    none = langid.identify(spark.createDataFrame(odd, "id int, text string"), langid.fit(taught.limit(0)))
    assert {r.language for r in none.collect()} == {"en"}
