"""Has this key been seen before? Sealed batches, one fingerprint filter per batch and shard.

Two forms. ``SeenKeys`` replays a whole table, each day against the days before it. ``SeenStore`` is a folder that outlives
the job: a step probes one batch against the sealed filters, then seals the batch's new keys as one more generation;
generations beyond ``GENERATIONS`` are merged into one, rebuilt from the stored keys, so that neither the probes of a key nor the
compounded error grow with the number of batches.

Memory: a task holds one shard's filters (about 2.5 bytes for each key ever sealed in
it) and the current batch's keys of that shard. The number of shards follows the
number of rows, so a task's share stays the same however long the history gets. Earlier keys are never held in memory.
They do stay on disk, once each: the filters' positives are looked up among them, so that the rows found are exact; the
report says how many positives were wrong, and the rate to expect of the filters alone.

Rows without a usable key are never "seen". Repeated rows (equal time and id) keep one
first row. An empty table gives empty results. Extra columns are ignored: the operator
selects the three it is told to read and names its own columns.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.functions.hashes import usable_hex
from frameloom.llm.filters import FINGERPRINT_BITS, FingerprintFilter
from frameloom.operators.skew import hot_of, salted
from frameloom.session import Scratch, rows_of

ROWS_PER_SHARD = 500_000
MIN_SHARDS = 12
#: Sealed generations of a store before they are merged into one.
GENERATIONS = 16
FILTER = "shard int, seed int, block bigint, n_keys bigint, prints binary"


def batch_keys(rows: DataFrame, id_col: str, key_col: str, time_col: str, digits: int = 64) -> DataFrame:
    """One row for each batch (UTC day) and key: the first row of it and how many there are."""
    return (
        rows.select(
            F.col(id_col).alias("row_id"),
            F.col(time_col).alias("seen_at"),
            F.unhex(usable_hex(F.col(key_col), digits)).alias("hash"),
        )
        .where(F.col("hash").isNotNull() & F.col("seen_at").isNotNull())
        .groupBy(F.datediff(F.col("seen_at"), F.lit("1970-01-01")).alias("batch"), "hash")
        .agg(F.min(F.struct("seen_at", "row_id")).alias("first"), F.count(F.lit(1)).alias("n"))
        .withColumn("key", F.xxhash64("hash"))
    )


def _replay(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard, batch after batch: probe the sealed generations, then seal the new keys."""
    pdf = pdf.drop_duplicates(["batch", "key"]).sort_values("batch", kind="stable")
    generations: list[FingerprintFilter] = []
    out = []
    for batch, part in pdf.groupby("batch", sort=True):
        keys = part["key"].to_numpy()
        hits = np.zeros(len(keys), dtype=bool)
        for sealed in generations:
            rest = np.flatnonzero(~hits)
            hits[rest] = sealed.contains(keys[rest])
        out.append(pd.DataFrame({"batch": batch, "key": keys, "maybe": hits, "generations": len(generations)}))
        generations.append(FingerprintFilter.build(keys[~hits]))
    return pd.concat(out)[["batch", "key", "maybe", "generations"]]


def probe_generations(keys: DataFrame, shards: int) -> DataFrame:
    """(batch, key, maybe, generations) for each row of ``batch_keys``, by filters alone.

    A key reaches its shard by its hash; a batch holds it once, so no group is hot.
    """
    return (
        keys.select("batch", "key", F.pmod(F.col("key"), F.lit(shards)).cast("int").alias("shard"))
        .groupBy("shard")
        .applyInPandas(_replay, "batch int, key bigint, maybe boolean, generations int")
    )


def seal(keys: DataFrame, shards: int) -> DataFrame:
    """The filters of one batch as rows to persist: (shard, seed, block, n_keys, prints)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = FingerprintFilter.build(pdf["key"].drop_duplicates().to_numpy())
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "seed": [made.seed], "block": [made.block], "n_keys": [pdf["key"].nunique()], "prints": [made.to_bytes()]})

    return (
        keys.select("key", F.pmod(F.col("key"), F.lit(shards)).cast("int").alias("shard"))
        .groupBy("shard")
        .applyInPandas(build, FILTER)
    )


def probe_sealed(keys: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """(key, maybe) of a new batch against persisted filters of any number of generations."""

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        probes = left["key"].drop_duplicates().to_numpy()
        hits = np.zeros(len(probes), dtype=bool)
        for seed, block, raw in zip(right["seed"], right["block"], right["prints"]):
            hits |= FingerprintFilter.from_bytes(int(seed), int(block), raw).contains(probes)
        return pd.DataFrame({"key": probes, "maybe": hits})

    new = keys.select("key", F.pmod(F.col("key"), F.lit(shards)).cast("int").alias("shard"))
    return new.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(probe, "key bigint, maybe boolean")


def shards_for(rows: int) -> int:
    return max(MIN_SHARDS, -(-rows // ROWS_PER_SHARD))


def wrong_rate(generations: Column, earlier: Column) -> Column:
    """Chance that a new key is taken for an old one: of some filter's fingerprint, or of equal 64-bit digests of different keys."""
    return 1 - F.pow(F.lit(1 - 2.0**-FINGERPRINT_BITS), generations) + earlier / F.lit(2.0**64)


def found_rows(rows: DataFrame, again: DataFrame, keys: DataFrame, total: int) -> DataFrame:
    """(image_id) of rows (row_id, seen_at, hash) by the answers (batch, hash, first, old) of their batch keys; rows of hot keys are salted."""
    hot = hot_of(keys.groupBy("hash").agg(F.sum("n").alias("n")), "hash", "n", total)
    mine, theirs = salted(rows.withColumn("batch", F.datediff("seen_at", F.lit("1970-01-01"))), again, "hash", F.col("row_id"), total, hot)
    met = mine.join(theirs, ["batch", "hash", "_salt"])
    return met.where(F.col("old") | (F.struct("seen_at", "row_id") > F.col("first"))).select(F.col("row_id").alias("image_id"))


class SeenKeys:
    """The operator over one table, with its written intermediate tables."""

    def __init__(self, rows: DataFrame, id_col: str = "id", key_col: str = "sha256_hash", time_col: str = "uploaded_at", digits: int = 64):
        self.rows, self.id_col, self.key_col, self.time_col, self.digits = rows, id_col, key_col, time_col, digits
        self.scratch = Scratch(rows.sparkSession, "seen")
        self.total = rows_of(rows)
        self.keys = self.scratch.write(batch_keys(rows, id_col, key_col, time_col, digits), "keys")
        self.probed = self.scratch.write(probe_generations(self.keys, shards_for(self.total)), "probed")

    def judged(self) -> DataFrame:
        """(batch, hash) of the filters' positives that are right: only these are looked up, in the first batch of each key."""
        maybe = self.keys.join(self.probed.where("maybe").select("batch", "key"), ["batch", "key"])
        firsts = self.keys.groupBy("hash").agg(F.min("batch").alias("old"))
        return maybe.join(firsts, "hash").where("old < batch").select("batch", "hash")

    def found(self) -> DataFrame:
        """Ids of the rows whose key an earlier row (by time, then id) has."""
        old = self.judged().withColumn("old", F.lit(True))
        again = self.keys.join(old, ["batch", "hash"], "left").where(F.col("old") | (F.col("n") > 1)).select("batch", "hash", "first", F.coalesce("old", F.lit(False)).alias("old"))
        rows = self.rows.select(F.col(self.id_col).alias("row_id"), F.col(self.time_col).alias("seen_at"), F.unhex(usable_hex(F.col(self.key_col), self.digits)).alias("hash"))
        return found_rows(rows, again, self.keys, self.total)

    def report(self) -> DataFrame:
        """For each batch: keys probed, the filters' yes, how many of those were wrong, how many to expect, and the stated rate."""
        exact = self.judged().groupBy("batch").agg(F.count(F.lit(1)).alias("true_seen"))
        per_batch = self.probed.groupBy("batch").agg(
            F.count(F.lit(1)).alias("probed_keys"),
            F.count_if("maybe").alias("filter_seen"),
            F.max("generations").alias("generations"),
        )
        firsts = self.keys.groupBy("hash").agg(F.min("batch").alias("batch")).groupBy("batch").agg(F.count(F.lit(1)).alias("new_keys"))
        told = per_batch.join(exact, "batch", "left").join(firsts, "batch", "left").withColumns({"true_seen": F.coalesce("true_seen", F.lit(0)), "new_keys": F.coalesce("new_keys", F.lit(0))})
        # One row for each batch, so a single task may order them.
        earlier = F.coalesce(F.sum("new_keys").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rate = wrong_rate(F.col("generations"), earlier)
        return told.select(
            F.date_add(F.lit("1970-01-01"), F.col("batch")).alias("batch_day"),
            "probed_keys", "filter_seen", "true_seen",
            (F.col("filter_seen") - F.col("true_seen")).alias("wrong_answers"),
            ((F.col("probed_keys") - F.col("true_seen")) * rate).alias("expected_wrong"),
            "generations", rate.alias("wrong_rate_bound"),
        )


class SeenStore:
    """Sealed filters and the keys they stand for, in a folder: ``layout``, ``filters/generation=k`` and ``keys`` (shard, hash).

    ``keys`` is partitioned by shard and sorted by hash within its files; a step reads the filters, and of the keys only the columns and shards its positives need.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.shards = spark.read.parquet(f"{path}/layout").first().shards

    @classmethod
    def create(cls, spark: SparkSession, path: str, shards: int) -> SeenStore:
        spark.createDataFrame([(shards,)], "shards int").coalesce(1).write.parquet(f"{path}/layout")
        store = cls(spark, path)
        none = spark.createDataFrame([], "key bigint, hash binary")
        store._append(none, 0)
        return store

    def _shard(self) -> Column:
        return F.pmod(F.col("key"), F.lit(self.shards)).cast("int")

    def filters(self) -> DataFrame:
        return self.spark.read.schema(f"{FILTER}, generation int").parquet(f"{self.path}/filters")

    def keys(self) -> DataFrame:
        return self.spark.read.schema("hash binary, shard int").parquet(f"{self.path}/keys")

    def generations(self) -> list[int]:
        """Their numbers; there are at most ``GENERATIONS`` and one."""
        return sorted(r.generation for r in self.filters().select("generation").distinct().collect())

    def _append(self, fresh: DataFrame, generation: int) -> None:
        """Seal new keys (key, hash) as one generation. The filters come last: a step that breaks off before may be repeated."""
        placed = fresh.select("hash", self._shard().alias("shard")).repartition("shard").sortWithinPartitions("shard", "hash")
        placed.write.mode("append").partitionBy("shard").parquet(f"{self.path}/keys")
        seal(fresh, self.shards).write.mode("overwrite").parquet(f"{self.path}/filters/generation={generation}")

    def merge(self, scratch: Scratch) -> None:
        """All generations become one, rebuilt from the stored keys."""
        old = self.generations()
        name = f"merged-{old[-1]}"
        scratch.write(seal(self.keys().dropDuplicates(["hash"]).select(F.xxhash64("hash").alias("key")), self.shards), name)
        self.spark.read.parquet(scratch.path(name)).write.mode("overwrite").parquet(f"{self.path}/filters/generation={old[-1] + 1}")
        for k in old:
            self._drop(f"{self.path}/filters/generation={k}")

    def _drop(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def step(self, rows: DataFrame, scratch: Scratch) -> DataFrame:
        """(image_id) of one batch's rows (row_id, seen_at, hash) whose key was seen before, in the store or earlier in the batch; the new keys are then sealed."""
        name = f"step-{len(scratch.made)}"
        held = rows.where(F.col("hash").isNotNull() & F.col("seen_at").isNotNull())
        keys = held.groupBy(F.datediff("seen_at", F.lit("1970-01-01")).alias("batch"), "hash").agg(F.min(F.struct("seen_at", "row_id")).alias("first"), F.count(F.lit(1)).alias("n"))
        keys, n = scratch.write_counted(keys.withColumn("key", F.xxhash64("hash")), f"{name}-keys", rows=F.sum("n"))
        past = self.generations()
        sealed = self.filters().where(F.col("generation").isin(past)).drop("generation")
        probed = scratch.write(probe_sealed(keys, sealed, self.shards), f"{name}-probed")
        maybe = keys.join(probed.where("maybe").select("key").distinct(), "key", "left_semi").select("hash", self._shard().alias("shard"))
        touched = [r.shard for r in maybe.select("shard").distinct().collect()]
        old = scratch.write(maybe.join(self.keys().where(F.col("shard").isin(touched)), ["shard", "hash"], "left_semi").select("hash"), f"{name}-old")
        again = keys.join(old.withColumn("old", F.lit(True)), "hash", "left").where(F.col("old") | (F.col("n") > 1)).select("batch", "hash", "first", F.coalesce("old", F.lit(False)).alias("old"))
        told = scratch.write(found_rows(held, again, keys, n["rows"]), f"{name}-told")
        self._append(keys.join(old, "hash", "left_anti").select("key", "hash"), max(past, default=0) + 1)
        if len(past) >= GENERATIONS:
            self.merge(scratch)
        return told


def incremental(table: DataFrame, days: int, id_col: str = "id", key_col: str = "sha256_hash", time_col: str = "uploaded_at", digits: int = 64) -> DataFrame:
    """(image_id) of the last ``days`` batches: a store sealed once from what came before, then one step a batch, opened anew each time."""
    spark = table.sparkSession
    scratch = Scratch(spark, "seen")
    rows = table.select(F.col(id_col).alias("row_id"), F.col(time_col).alias("seen_at"), F.unhex(usable_hex(F.col(key_col), digits)).alias("hash"))
    rows, n = scratch.write_counted(rows.withColumn("batch", F.datediff("seen_at", F.lit("1970-01-01"))), "rows")
    last = sorted(r.batch for r in rows.where("batch is not null").select("batch").distinct().orderBy(F.desc("batch")).limit(days).collect())
    if not last:
        return rows.select(F.col("row_id").alias("image_id")).limit(0)
    path = scratch.path("store")
    past = rows.where((F.col("batch") < last[0]) & F.col("hash").isNotNull()).select("hash").distinct()
    SeenStore.create(spark, path, shards_for(n["n"]))._append(past.withColumn("key", F.xxhash64("hash")), 1)
    return reduce(DataFrame.union, [SeenStore(spark, path).step(rows.where(F.col("batch") == day).drop("batch"), scratch) for day in last])
