"""Canonical hashes of index manifests and runtimes, and the gate that stops questions to an index that is out of date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from sparkloom.operators.vectors import namespace

COMPARED = ("dimension", "chunk_profile", "embedding_provider", "embedding_model", "source_catalog_hash")


def _quoted(text: Column) -> Column:
    """A JSON string of ASCII characters only: others as escaped UTF-16 units, in lower case."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}

    def one(c: Column) -> Column:
        code = F.ascii(c)
        above = code - 0x10000
        pair = F.concat(unit(F.shiftright(above, 10) + 0xD800), unit(above.bitwiseAND(F.lit(0x3FF)) + 0xDC00))
        out = F.when(code > 0xFFFF, pair).when((code < 0x20) | (code > 0x7E), unit(code)).otherwise(c)
        for raw, escaped in short.items():
            out = F.when(c == raw, escaped).otherwise(out)
        return out

    plain = F.concat(F.lit('"'), text, F.lit('"'))
    spelled = F.concat(F.lit('"'), F.array_join(F.transform(F.split(text, ""), one), ""), F.lit('"'))
    return F.when(text.rlike(r'\A[ !#-\[\]-~]*\z'), plain).otherwise(spelled)


def canonical_json(value: Column, kind: S.DataType) -> Column:
    """A value of that type as JSON with sorted keys, no blanks and ASCII characters only, the same whatever the order of fields and map entries.

    Null fields are null; a null value as a whole is the text null.  Strings,
    booleans, integers, arrays, structs and maps with string keys; fractions and
    times have no one spelling and are an error.
    """
    comma = lambda xs: F.array_join(xs, ",")
    match kind:
        case S.StringType():
            out = _quoted(value)
        case S.BooleanType() | S.ByteType() | S.ShortType() | S.IntegerType() | S.LongType():
            out = value.cast("string")
        case S.ArrayType():
            out = F.concat(F.lit("["), comma(F.transform(value, lambda x: canonical_json(x, kind.elementType))), F.lit("]"))
        case S.MapType(keyType=S.StringType()):
            entry = lambda e: F.concat(_quoted(e["key"]), F.lit(":"), canonical_json(e["value"], kind.valueType))
            keys = F.array_sort(F.map_keys(value))
            entries = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(value, k).alias("value")))
            out = F.concat(F.lit("{"), comma(F.transform(entries, entry)), F.lit("}"))
        case S.StructType():
            fields = sorted(kind.fields, key=lambda f: f.name)
            parts = [F.concat(_quoted(F.lit(f.name)), F.lit(":"), canonical_json(value[f.name], f.dataType)) for f in fields]
            out = F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
        case _:
            raise TypeError(f"{kind.simpleString()} has no canonical form")
    return F.coalesce(out, F.lit("null"))


def manifest_hash(rows: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of the canonical JSON of a row's columns."""
    kept = rows.select(*(columns or rows.columns))
    return F.sha2(canonical_json(F.struct(*kept.columns), kept.schema), 256)


def active_hashes(runtimes: DataFrame, manifests: DataFrame) -> DataFrame:
    """(namespace, active_hash) for each runtime, which is (namespace, the compared settings, hosted boolean).

    The hash of the namespace's manifest if all compared settings agree, nulls
    with nulls; '' if they don't; without a manifest the hash of the settings
    themselves where the index is hosted, else ''.  One manifest a namespace.
    """
    own = manifests.withColumn("namespace", namespace(F.col("namespace")))
    hashed = own.select(F.col("namespace").alias("of"), manifest_hash(own).alias("manifest_hash"), *(F.col(c).alias(f"manifest_{c}") for c in COMPARED))
    ran = runtimes.withColumn("namespace", namespace(F.col("namespace")))
    ran = ran.withColumn("runtime_hash", manifest_hash(ran, ["namespace", *COMPARED]))
    met = ran.join(hashed, F.col("namespace") == F.col("of"), "left")
    agree = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"manifest_{c}")) for c in COMPARED))
    active = F.when(F.col("of").isNotNull(), F.when(agree, F.col("manifest_hash")).otherwise("")).when(F.col("hosted"), F.col("runtime_hash")).otherwise("")
    return met.select("namespace", active.alias("active_hash"))


def with_stale(requests: DataFrame, active: DataFrame) -> DataFrame:
    """requests (namespace, and index_hash where evidence was staged before) with active_hash and stale.

    Stale is a request whose namespace has no active index, and one whose
    evidence was staged under another hash.  Pass `stale` on to
    `retrieval.stage_evidence`.
    """
    met = requests.withColumn("__of", namespace(F.col("namespace"))).join(active.withColumnsRenamed({"namespace": "__of"}), "__of", "left").drop("__of")
    gone = F.coalesce("active_hash", F.lit("")) == ""
    other = F.coalesce(F.col("index_hash") != F.col("active_hash"), F.lit(False)) if "index_hash" in requests.columns else F.lit(False)
    return met.withColumns({"active_hash": F.coalesce("active_hash", F.lit("")), "stale": gone | other})
