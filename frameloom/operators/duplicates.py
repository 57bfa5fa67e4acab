"""Exact and near duplicates of a table of fingerprints (id, sha256_hash, perceptual_hash and its halves ahash_hi, ahash_lo, uploaded_at).

Hashes count by their usable digits, however they are written; halves that are missing are taken from the
perceptual hash. Exact: of each hash the two earliest rows are kept, by one aggregation whose partial results come before the
shuffle; a row's match is the first of them that is not itself, so a hash that a third of all rows share costs as much as any other.
Near: by default the snapshot rule, the newest ``window`` fingerprints other than the row's own, the closest of them,
the newer of two equally close. ``as_of="upload"`` looks at the ``window`` uploads before the row
instead, and ``near_pairs`` compares all pairs within the distance by band keys. Rows with an exact match are not searched for near ones.

Rows without a usable hash have no exact match, rows without a usable fingerprint no near one. Repeated rows of one id repeat its exact match and have one near match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.config import Config
from frameloom.functions.columns import fingerprint_hex
from frameloom.functions.hashes import hamming_halves, usable_hex
from frameloom.operators.skew import hot_of, salted
from frameloom.session import Scratch

SNAPSHOT, UPLOAD = "snapshot", "upload"


def fingerprinted(rows: DataFrame) -> DataFrame:
    """(id, uploaded_at, ahash_hi, ahash_lo) of the rows with a fingerprint: their halves, or those of a usable perceptual hash."""
    hi, lo = F.col("ahash_hi"), F.col("ahash_lo")
    if "perceptual_hash" in rows.columns:
        digits = usable_hex(F.col("perceptual_hash"), 16)
        whole = hi.isNotNull() & lo.isNotNull()
        half = lambda at: F.conv(F.substring(digits, at, 8), 16, 10).cast("bigint")
        hi, lo = F.when(whole, hi).otherwise(half(1)), F.when(whole, lo).otherwise(half(9))
    return rows.select("id", "uploaded_at", hi.alias("ahash_hi"), lo.alias("ahash_lo")).where("ahash_hi is not null and ahash_lo is not null")


def exact_matches(rows: DataFrame) -> DataFrame:
    """(id, matched_id, matched_at): for each row with a copy, the earliest other one."""
    held = rows.select("id", "uploaded_at", usable_hex(F.col("sha256_hash"), 64).alias("sha")).where(F.col("sha").isNotNull())
    scratch = Scratch(rows.sparkSession, "exact")
    held, n = scratch.write_counted(held, "held")
    spot = F.struct(F.col("uploaded_at").alias("at"), F.col("id").alias("id"))
    # The least place and the greatest in one pass; only where there are more rows may the second lie between.
    first = held.groupBy("sha").agg(F.min(spot).alias("first"), F.max(spot).alias("last"), F.count(F.lit(1)).alias("n")).where("first.id <> last.id")
    first = scratch.write(first, "first")
    hot = hot_of(first.where("n > 2"), "sha", "n", n["n"])
    mine, theirs = salted(held, first.where("n > 2").select("sha", "first"), "sha", F.col("id"), n["n"], hot)
    between = mine.join(theirs, ["sha", "_salt"]).where(F.col("id") != F.col("first.id")).groupBy("sha").agg(F.min(spot).alias("second"))
    both = first.join(between, "sha", "left").select("sha", "first", F.coalesce("second", "last").alias("second"))
    mine, theirs = salted(held, scratch.write(both, "both"), "sha", F.col("id"), n["n"], hot_of(first, "sha", "n", n["n"]))
    match = F.when(F.col("id") == F.col("first.id"), F.col("second")).otherwise(F.col("first"))
    return mine.join(theirs, ["sha", "_salt"]).select("id", match["id"].alias("matched_id"), match["at"].alias("matched_at"))


def near_in_window(rows: DataFrame, config: Config, asked: DataFrame | None = None) -> DataFrame:
    """(id, matched_id, distance) under the snapshot rule, of all rows or of the ids in ``asked`` only.

    The candidates of every row lie among the newest window + 1 rows: a row inside the window
    reaches one further in place of itself. That many rows, a configured number, are broadcast; the pairs of a row are
    reduced to the closest one where they arise, before the shuffle by id.
    """
    held = fingerprinted(rows)
    newest = held.orderBy(F.desc("uploaded_at"), F.desc("id")).limit(config.near_window + 1)
    ranked = newest.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("uploaded_at"), F.desc("id"))))
    other = ranked.select(F.col("id").alias("matched_id"), F.col("ahash_hi").alias("hi"), F.col("ahash_lo").alias("lo"), "rank")
    own = ranked.where(F.col("rank") <= config.near_window).select("id", F.lit(1).alias("inside"))
    if asked is not None:
        held = held.join(asked, "id", "left_semi")
    reach = F.col("rank") <= config.near_window + F.coalesce("inside", F.lit(0))
    distance = hamming_halves(F.col("ahash_hi"), F.col("ahash_lo"), F.col("hi"), F.col("lo"))
    # The limit is part of the join: a farther pair decides nothing, since the closest one is asked for.
    near = (F.col("id") != F.col("matched_id")) & reach & (distance <= config.near_distance)
    pairs = held.join(F.broadcast(own), "id", "left").join(F.broadcast(other), near)
    best = pairs.groupBy("id").agg(F.min(F.struct(distance.alias("distance"), F.col("rank"), F.col("matched_id"))).alias("best"))
    return best.select("id", F.col("best.matched_id").alias("matched_id"), F.col("best.distance").alias("distance"))


def with_sequence(rows: DataFrame) -> DataFrame:
    """Adds ``seq``, the place in (uploaded_at, id) order from 0: a range sort and offsets per partition, no single task."""
    ordered = rows.repartitionByRange("uploaded_at", "id").sortWithinPartitions("uploaded_at", "id").withColumn("_p", F.spark_partition_id())
    ordered = Scratch(rows.sparkSession, "sequence").write(ordered, "ordered")
    counts = ordered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition, so a single task may order them.
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_p").orderBy("uploaded_at", "id")) - 1
    return ordered.join(offsets, "_p").withColumn("seq", place + F.col("_before")).drop("_p", "_n", "_before")


def near_before_upload(rows: DataFrame, config: Config) -> DataFrame:
    """(id, matched_id, distance) among the ``window`` fingerprints uploaded just before the row; blocks meet by equal number."""
    w = config.near_window
    held = with_sequence(fingerprinted(rows))
    block = F.floor(F.col("seq") / w)
    left = held.select("id", "ahash_hi", "ahash_lo", "seq", F.explode(F.array(block, block - 1)).alias("block"))
    right = held.select(F.col("id").alias("matched_id"), F.col("ahash_hi").alias("hi"), F.col("ahash_lo").alias("lo"), F.col("seq").alias("s"), block.alias("block"))
    distance = hamming_halves(F.col("ahash_hi"), F.col("ahash_lo"), F.col("hi"), F.col("lo"))
    pairs = left.join(right, "block").where((F.col("s") < F.col("seq")) & (F.col("s") >= F.col("seq") - w) & (distance <= config.near_distance))
    best = pairs.groupBy("id").agg(F.min(F.struct(distance.alias("distance"), (-F.col("s")).alias("newer"), F.col("matched_id"))).alias("best"))
    return best.select("id", F.col("best.matched_id").alias("matched_id"), F.col("best.distance").alias("distance"))


def near_pairs(fingerprints: DataFrame, distance: int) -> DataFrame:
    """(id_a, id_b, distance) of all pairs of *different* fingerprints within the distance, represented by their smallest ids.

    Pigeonhole: of distance + 1 bands of the 64 bits two such fingerprints share one. Copies of one
    fingerprint are represented once (see ``fingerprint_classes``), so they are never paired.
    """
    bands = distance + 1
    sizes = [64 // bands + (i < 64 % bands) for i in range(bands)]
    value = F.shiftleft(F.col("ahash_hi"), 32).bitwiseOR(F.col("ahash_lo"))
    classes = fingerprint_classes(fingerprints).withColumn("v", value)
    keys, start = [], 0
    for i, n in enumerate(sizes):
        keys.append(F.struct(F.lit(i).alias("no"), F.shiftrightunsigned("v", start).bitwiseAND(F.lit((1 << n) - 1)).alias("bits")))
        start += n
    keyed = classes.select(F.col("class_id").alias("id"), "v", F.inline(F.array(*keys)))
    other = keyed.select(F.col("id").alias("id_b"), F.col("v").alias("w"), "no", "bits")
    apart = F.bit_count(F.col("v").bitwiseXOR(F.col("w")))
    pairs = keyed.join(other, ["no", "bits"]).where((F.col("id") < F.col("id_b")) & (apart <= distance))
    return pairs.select(F.col("id").alias("id_a"), "id_b", apart.alias("distance")).distinct()


def fingerprint_classes(rows: DataFrame) -> DataFrame:
    """Each different fingerprint once: smallest id as class, and the number of its rows."""
    held = fingerprinted(rows.withColumn("uploaded_at", F.lit(None)))
    return held.groupBy("ahash_hi", "ahash_lo").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("members"))


def verdicts(rows: DataFrame, config: Config, as_of: str = SNAPSHOT) -> DataFrame:
    """(id, match_type, matched_id, matched_at, distance) of every row with a match; exact comes first, and only the rest is searched for near ones."""
    exact = Scratch(rows.sparkSession, "verdicts").write(exact_matches(rows), "exact")
    rest = rows.select("id").join(exact.select("id"), "id", "left_anti")
    near = near_in_window(rows, config, rest) if as_of == SNAPSHOT else near_before_upload(rows, config).join(rest, "id", "left_semi")
    told = exact.select("id", F.lit("exact").alias("match_type"), "matched_id", "matched_at", F.lit(None).cast("int").alias("distance"))
    near = near.select("id", F.lit("near_duplicate").alias("match_type"), "matched_id", F.lit(None).cast(rows.schema["uploaded_at"].dataType).alias("matched_at"), F.col("distance").cast("int").alias("distance"))
    return told.unionByName(near)


def with_fingerprint_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("perceptual_hash", fingerprint_hex(F.col("ahash_hi"), F.col("ahash_lo")))
