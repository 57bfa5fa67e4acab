"""Deduplicating new batches against all history: a persisted index of band keys with signatures.

The signature is the 64-bit perceptual hash. Two signatures within ``distance`` bits agree
on at least ``pieces - distance`` of ``pieces`` pieces of it, so every choice of
that many pieces gives a band key and two near signatures share one of them: nothing is missed.
(Minwise keys would miss a share of the pairs at any number of bands, which the
required result does not allow; see README.) The index stores each distinct signature once,
with the first batch that had it, however many rows carry it; a probe joins a new
signature to the index on equal band keys only, verifies the distance on the signatures
themselves, and stops at the first older one within it (a semi join), so a crowded bucket
emits no pairs; signatures of a hot band key are spread over tasks.

An index is a folder: its layout (pieces, buckets, distance) is written into it when it is made and read when it is opened. One
step probes one batch, reading only the buckets its keys fall in, and appends what the batch brought.

Why only first batches matter: a row is a near copy if some signature within the distance
came in an earlier batch. If its own signature did, that decides; otherwise the row is in
its signature's first batch and only older signatures can decide.

Rows without a usable hash match nothing by it. Rows of the same batch never match each
other. Repeated rows get the same answer. Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.hashes import hamming64, hex64, usable_hex
from frameloom.operators.skew import hot_of, salted
from frameloom.session import Scratch

DISTANCE = 5
BITS = 64
BUCKETS = 64


def pieces_for(signatures: int, distance: int = DISTANCE) -> int:
    """More, and so longer, band keys for longer histories: about 2**4 signatures a bucket at most.

    Every choice finds all near pairs; only the work differs.
    """
    pieces = distance + 2
    while signatures >> 4 > 2 ** (BITS * (pieces - distance) // pieces) and pieces < distance + 4:
        pieces += 1
    return pieces


def _width(pieces: int, distance: int) -> int:
    """Bits of the longest band key, above which stands the number of its choice of pieces."""
    return sum(sorted((BITS // pieces + (i < BITS % pieces) for i in range(pieces)), reverse=True)[: pieces - distance])


def band_keys(sig: Column, pieces: int, distance: int = DISTANCE) -> Column:
    """Array of band keys: for each choice of pieces their bits, with the choice's number above them."""
    sizes = [BITS // pieces + (i < BITS % pieces) for i in range(pieces)]
    starts = [sum(sizes[:i]) for i in range(pieces)]
    cut = [F.shiftrightunsigned(sig, starts[i]).bitwiseAND(F.lit((1 << sizes[i]) - 1)) for i in range(pieces)]
    keys = []
    for number, chosen in enumerate(combinations(range(pieces), pieces - distance)):
        key = F.lit(0).cast("bigint")
        for i in chosen:
            key = F.shiftleft(key, sizes[i]).bitwiseOR(cut[i])
        keys.append(key.bitwiseOR(F.lit(number << _width(pieces, distance)).cast("bigint")))
    return F.array(*keys)


class HistoryIndex:
    """The persisted index: ``bands`` (bucket, key, sig, first_batch) and ``hashes`` (bucket, hash, first_batch).

    Both are Parquet tables partitioned by a bucket of the key's hash, sorted by key within a file, so that a probe reads the
    buckets its own keys fall in; appending adds files and rewrites nothing.
    """

    def __init__(self, spark: SparkSession, path: str, pieces: int, distance: int = DISTANCE, buckets: int = BUCKETS):
        self.spark, self.path, self.pieces, self.distance, self.buckets = spark, path, pieces, distance, buckets

    @classmethod
    def create(cls, spark: SparkSession, path: str, pieces: int, distance: int = DISTANCE, buckets: int = BUCKETS) -> HistoryIndex:
        """An empty index; its layout holds for all that is ever appended."""
        made = cls(spark, path, pieces, distance, buckets)
        spark.createDataFrame([(pieces, distance, buckets)], "pieces int, distance int, buckets int").coalesce(1).write.parquet(f"{path}/layout")
        none = spark.createDataFrame([], "sig bigint, first_batch int"), spark.createDataFrame([], "hash string, first_batch int")
        made.append(*none)
        return made

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> HistoryIndex:
        held = spark.read.parquet(f"{path}/layout").first()
        return cls(spark, path, held.pieces, held.distance, held.buckets)

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int").alias("bucket")

    def keyed(self, sigs: DataFrame) -> DataFrame:
        flat = sigs.select(F.explode(band_keys(F.col("sig"), self.pieces, self.distance)).alias("key"), "sig", "first_batch")
        return flat.select(self._bucket("key"), "key", "sig", "first_batch")

    def hashed(self, hashes: DataFrame) -> DataFrame:
        return hashes.select(self._bucket("hash"), "hash", "first_batch")

    def append(self, sigs: DataFrame | None = None, hashes: DataFrame | None = None) -> None:
        """Add (sig, first_batch) and (hash, first_batch); call once for each accepted batch."""
        for name, df, key in (("bands", sigs and self.keyed(sigs), "key"), ("hashes", hashes and self.hashed(hashes), "hash")):
            if df is not None:
                once = df.repartition("bucket").sortWithinPartitions("bucket", key)
                once.write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def bands(self) -> DataFrame:
        return self.spark.read.schema("key bigint, sig bigint, first_batch int, bucket int").parquet(f"{self.path}/bands")

    def hashes(self) -> DataFrame:
        return self.spark.read.schema("hash string, first_batch int, bucket int").parquet(f"{self.path}/hashes")

    def _touched(self, keyed: DataFrame) -> Column:
        """Condition on the buckets that keys fall in: at most ``buckets`` numbers come to the driver, and prune the folders read."""
        return F.col("bucket").isin([r.bucket for r in keyed.select("bucket").distinct().collect()])

    def near(self, keyed: DataFrame, total: int, old: DataFrame | None = None) -> DataFrame:
        """The distinct signatures of ``keyed`` (``total`` band keys) that an older batch comes near to."""
        new = keyed.select("key", "sig", "first_batch")
        old = (self.bands() if old is None else old).select("key", F.col("sig").alias("s"), F.col("first_batch").alias("f"))
        mine, theirs = salted(new, old, "key", F.col("sig"), total)
        theirs = theirs.select(F.col("key").alias("k"), "s", "f", F.col("_salt").alias("t"))
        met = (F.col("key") == F.col("k")) & (F.col("_salt") == F.col("t")) & (F.col("f") < F.col("first_batch"))
        return mine.join(theirs, met & (hamming64(F.col("sig"), F.col("s")) <= self.distance), "left_semi").select("sig").distinct()

    def step(self, now: DataFrame, scratch: Scratch) -> DataFrame:
        """(image_id, match_kind) of the rows of one batch (row_id, batch, hash, sig) against the index, to which the batch is then appended."""
        name = f"step-{len(scratch.made)}"
        sigs, ns = scratch.write_counted(firsts(now, "sig").select("sig", "first_batch", "n"), f"{name}-sigs")
        hashes, nh = scratch.write_counted(firsts(now, "hash").select("hash", "first_batch", "n"), f"{name}-hashes")
        keyed, n = scratch.write_counted(self.keyed(sigs), f"{name}-keys")
        old = self.bands().where(self._touched(keyed))
        near = scratch.write(self.near(keyed, n["n"], old), f"{name}-near")
        seen = self.hashes().where(self._touched(self.hashed(hashes))).select("hash")
        seen = scratch.write(hashes.join(seen, "hash", "left_semi"), f"{name}-seen")
        told = _told(now, seen.select("hash", F.lit(-1).alias("hash_first"), "n"), near.join(sigs, "sig").select("sig", F.lit(-1).alias("sig_first"), F.lit(False).alias("near"), "n"), now.count())
        told = scratch.write(told, f"{name}-told")
        # Signatures the index holds already are told by equality under one band key.
        first = keyed.where(F.shiftright("key", _width(self.pieces, self.distance)) == 0)
        known = first.join(old.select("key", "sig"), ["key", "sig"], "left_semi").select("sig")
        fresh = scratch.write(sigs.join(known, "sig", "left_anti").select("sig", "first_batch"), f"{name}-fresh")
        self.append(fresh, hashes.join(seen, "hash", "left_anti").select("hash", "first_batch"))
        return told


def batches(rows: DataFrame, id_col: str = "id", hash_col: str = "sha256_hash", sig_col: str = "perceptual_hash", time_col: str = "uploaded_at") -> DataFrame:
    """(row_id, batch, hash, sig): the UTC day as batch number, null where a hash isn't usable."""
    return rows.select(
        F.col(id_col).alias("row_id"),
        F.datediff(F.col(time_col), F.lit("1970-01-01")).alias("batch"),
        usable_hex(F.col(hash_col), 64).alias("hash"),
        hex64(usable_hex(F.col(sig_col), 16)).alias("sig"),
    ).where(F.col("batch").isNotNull())


def firsts(rows: DataFrame, value: str) -> DataFrame:
    """Each distinct value once, with its first and last batch and its number of rows; partial sums come before the shuffle."""
    return rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min("batch").alias("first_batch"), F.max("batch").alias("last_batch"), F.count(F.lit(1)).alias("n"))


def _told(rows: DataFrame, hashes: DataFrame, sigs: DataFrame, total: int) -> DataFrame:
    """(image_id, match_kind) from (hash, hash_first, n) and (sig, sig_first, near, n) of the values that may match.

    A row without a hash joins under its own id, so that nulls don't gather in one task; rows of hot values are salted.
    """
    keyed = rows.withColumns({"h": F.coalesce("hash", "row_id"), "s": F.coalesce(F.col("sig").cast("string"), "row_id")})
    by_hash = hashes.withColumnRenamed("hash", "h")
    mine, theirs = salted(keyed, by_hash.drop("n"), "h", F.col("row_id"), total, hot_of(by_hash, "h", "n", total))
    keyed = mine.join(theirs, ["h", "_salt"], "left").drop("_salt")
    by_sig = sigs.withColumn("s", F.col("sig").cast("string")).drop("sig")
    mine, theirs = salted(keyed, by_sig.drop("n"), "s", F.col("row_id"), total, hot_of(by_sig, "s", "n", total))
    told = mine.join(theirs, ["s", "_salt"], "left")
    kind = F.when(F.col("hash_first") < F.col("batch"), "exact").when((F.col("sig_first") < F.col("batch")) | ((F.col("sig_first") == F.col("batch")) & F.col("near")), "near")
    return told.select(F.col("row_id").alias("image_id"), kind.alias("match_kind")).where(F.col("match_kind").isNotNull())


def replay(table: DataFrame, distance: int = DISTANCE, **columns: str) -> DataFrame:
    """(image_id, match_kind) of every row, each batch against the batches before it.

    All batches go through the index at once: an entry carries the batch that
    brought it, and a probe of batch b sees the entries of batches before b,
    which is what appending batch by batch would leave there.
    """
    spark, rows = table.sparkSession, batches(table, **columns)
    scratch = Scratch(spark, "history")
    sigs, n = scratch.write_counted(firsts(rows, "sig"), "sigs")
    hashes = firsts(rows, "hash")
    index = HistoryIndex.create(spark, scratch.path("index"), pieces_for(n["n"], distance), distance)
    index.append(sigs.select("sig", "first_batch"))
    choices = len(list(combinations(range(index.pieces), index.pieces - distance)))
    near = index.near(index.bands(), n["n"] * choices).withColumn("near", F.lit(True))
    copied = sigs.join(near, "sig", "left").where(F.col("near") | (F.col("last_batch") > F.col("first_batch")))
    copied = copied.select("sig", F.col("first_batch").alias("sig_first"), F.coalesce("near", F.lit(False)).alias("near"), "n")
    again = scratch.write(hashes.where("last_batch > first_batch").select("hash", F.col("first_batch").alias("hash_first"), "n"), "again")
    return _told(rows, again, scratch.write(copied, "copied"), table.count())


def incremental(table: DataFrame, days: int, distance: int = DISTANCE, **columns: str) -> DataFrame:
    """(image_id, match_kind) of the last ``days`` batches: an index written once from what came before, then one step a batch, opened anew each time."""
    spark, rows = table.sparkSession, batches(table, **columns)
    scratch = Scratch(spark, "history")
    rows = scratch.write(rows, "rows")
    last = sorted(r.batch for r in rows.select("batch").distinct().orderBy(F.desc("batch")).limit(days).collect())
    if not last:
        return rows.select(F.col("row_id").alias("image_id"), F.lit(None).cast("string").alias("match_kind")).limit(0)
    past, path = rows.where(F.col("batch") < last[0]), scratch.path("index")
    sigs, n = scratch.write_counted(firsts(past, "sig").select("sig", "first_batch"), "past")
    HistoryIndex.create(spark, path, pieces_for(n["n"], distance), distance).append(sigs, firsts(past, "hash").select("hash", "first_batch"))
    return reduce(DataFrame.union, [HistoryIndex.open(spark, path).step(rows.where(F.col("batch") == day), scratch) for day in last])
