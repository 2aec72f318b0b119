"""Problem 5: references to records that do not exist, per row and per table and month.

A Bloom filter over the parent keys, built by Spark's own aggregate and read as a scalar
subquery, proves most orphans without a join: a key that it does not hold has no parent. Its
size is bounded (see ``MAX_BITS``), so it may go to every task. Only the distinct keys that
it does hold are joined exactly. Rows are joined last, and only with the few bad keys, so a
healthy hot key is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage

#: 2 MB: the filter has BITS_PER_KEY bits for each expected key, but never more than these.
#: Beyond about 1.6 million keys more references pass the filter and are verified by the
#: join; the result is the same.
MAX_BITS = 1 << 24
BITS_PER_KEY = 10
BLANKS = r"[\s\p{Z}]"


def bare_id(reference: Column) -> Column:
    """The id in a reference written bare, as ``scheme:kind:id`` or as a link; '' for blank or null.

    Upper and lower case count. What fits no form is kept as it is, without outer blanks.
    """
    text = F.regexp_replace(F.coalesce(reference, F.lit("")), f"^{BLANKS}+|{BLANKS}+$", "")
    found = F.regexp_extract(text, r"^(?:.*[/:])?([^/:?#\s]+)/?(?:[?#].*)?$", 1)
    return F.when(found != "", found).otherwise(text)


def _jvm_call(spark: SparkSession, name: str, *columns: Column) -> Column:
    from pyspark.sql.classic.column import _to_java_column, _to_seq

    sc = spark.sparkContext
    return Column(sc._jvm.PythonSQLUtils.internalFn(name, _to_seq(sc, list(columns), _to_java_column)))


def might_contain(keys: DataFrame, key: str, probe: Column, expected: int) -> Column:
    """False where ``probe`` is certainly not among ``keys.key``. Lazy: no job runs here.

    ``expected`` keys give about 1 % false hits; more keys give more of them, never a wrong False.
    """
    spark = keys.sparkSession
    bits = min(MAX_BITS, max(1 << 13, expected * BITS_PER_KEY))
    bloom = keys.agg(
        _jvm_call(spark, "bloom_filter_agg", F.xxhash64(key), F.lit(max(1, bits // BITS_PER_KEY)).cast("long"), F.lit(bits).cast("long")).alias("bloom")
    )
    jvm = spark.sparkContext._jvm
    wrap = jvm.org.apache.spark.sql.classic.ExpressionUtils
    test = jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(
        wrap.expression(bloom.scalar()._jc), wrap.expression(F.xxhash64(probe)._jc)
    )
    return F.coalesce(Column(wrap.column(test)), F.lit(False))


def orphans(
    child: DataFrame, child_id: str, reference: str, seen_at: str, parent: DataFrame, parent_id: str, parent_at: str, deleted_at: str
) -> DataFrame:
    """The rows (child_id, seen_at, why) of ``child`` whose reference leads nowhere.

    ``why`` is 'missing' (no parent row has the id, at any time) or 'deleted' (the latest
    parent row has a deletion time not after the time of the reference). Blank and null
    references are no references. Of parent rows with equal times a deleted one counts as
    the later; a null time is the earliest. A reference without time is never 'deleted'.
    Repeated child rows give repeated results. With an empty parent every reference is missing.
    """
    refs = child.select(F.col(child_id).alias("child_id"), F.col(seen_at).alias("seen_at"), bare_id(F.col(reference)).alias("key")).filter(
        F.col("key") != ""
    )
    versions = parent.select(
        bare_id(F.col(parent_id)).alias("key"), F.struct(F.col(parent_at).alias("at"), F.col(deleted_at).alias("gone")).alias("version")
    ).filter(F.col("key") != "")
    latest = versions.groupBy("key").agg(F.max("version").alias("version")).select("key", F.col("version.gone").alias("gone"))
    known = might_contain(versions, "key", F.col("key"), versions.count())
    certain = refs.filter(~known).select("child_id", "seen_at", F.lit("missing").alias("why"))
    false_hits = refs.filter(known).select("key").distinct().join(latest, "key", "left_anti").select("key", F.lit(None).cast("timestamp").alias("gone"))
    gone = latest.filter(F.col("gone").isNotNull()).select("key", F.col("gone").cast("timestamp").alias("gone"))
    bad = cut_lineage(false_hits.unionByName(gone))
    verified = (
        refs.filter(might_contain(bad, "key", F.col("key"), bad.count()))
        .join(bad, "key")
        .filter(F.col("gone").isNull() | (F.col("gone") <= F.col("seen_at")))
        .select("child_id", "seen_at", F.when(F.col("gone").isNull(), "missing").otherwise("deleted").alias("why"))
    )
    return certain.unionByName(verified)


def orphan_report(tab: str, child: DataFrame, reference: str, seen_at: str, found: DataFrame) -> DataFrame:
    """Counts (tab, month, n_refs, n_missing, n_deleted) of the references and orphans of one table, months in UTC."""
    month = F.date_format(F.to_utc_timestamp("seen_at", F.current_timezone()), "yyyy-MM")
    refs = child.select(F.col(seen_at).alias("seen_at"), bare_id(F.col(reference)).alias("key")).filter(F.col("key") != "")
    counted = refs.select(month.alias("month"), F.lit(1).alias("ref"), F.lit(None).cast("string").alias("why")).unionByName(
        found.select(month.alias("month"), F.lit(0).alias("ref"), "why")
    )
    return (
        counted.groupBy("month")
        .agg(
            F.sum("ref").cast("long").alias("n_refs"),
            F.count_if(F.col("why") == "missing").alias("n_missing"),
            F.count_if(F.col("why") == "deleted").alias("n_deleted"),
        )
        .select(F.lit(tab).alias("tab"), "month", "n_refs", "n_missing", "n_deleted")
    )
