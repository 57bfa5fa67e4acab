"""Consolidating pairwise matches into groups: peel the giant component, then spread minima.

1. Links are made undirected, distinct and free of loops.
2. Chains are contracted: links between two vertices of at most two links each are labelled by minimum propagation
   (step 5), so that a long chain that hangs on the giant costs the logarithm of its length below, not its length.
3. From the vertex of highest degree a breadth-first search joins frontier and links, round by
   round, until nothing new is met; a frontier vertex is emitted once however many links reach it.
   Neighbours of a frontier lie in it, in the one before or in the next, so only these two are subtracted.
4. The links of the peeled component are removed by an anti-join.
5. The remaining components are labelled with their smallest vertex by minimum propagation: each
   vertex takes the smallest label around it, labels jump to their own labels, and links are
   carried over to the labels, until none joins two of them. Chains shrink by a factor each
   round, so the number of rounds follows the logarithm of the longest path.

Each round is written to the shared folder; nothing is collected but counts and the one vertex the search starts
from. Vertices are 16-byte values. A vertex without links is in no group; an empty link table gives none.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from frameloom.functions.details import read_json
from frameloom.operators.skew import salted
from frameloom.session import Scratch

UUID = re.compile(r"(?<![0-9a-f])[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}(?![0-9a-f])")
LINK_TYPES = ("exact", "near_duplicate")
#: Links a vertex of a chain has at most.
CHAIN = 2


def _id_in(value) -> str | None:
    found = UUID.search(value.lower()) if isinstance(value, str) else None
    return found[0].replace("-", "") if found else None


def _squeezed(key: str) -> str:
    return key.lower().replace("_", "").replace("-", "")


def matched_ids(text: str | None) -> list[str]:
    """The 32 hex digits of every matched image that readable details name, without listed candidates."""
    value, out = read_json(text), []
    for one in value if isinstance(value, list) else [value]:
        if not isinstance(one, dict) or one.get("matchType") not in LINK_TYPES:
            continue
        for key, held in one.items():
            name = _squeezed(key)
            if not name.startswith("match"):
                continue
            if isinstance(held, dict):
                held = next((v for k, v in held.items() if _squeezed(k) in ("id", "imageid", "uuid") or _squeezed(k).endswith("imageid")), None)
            if found := _id_in(held):
                out.append(found)
    return out


@pandas_udf(ArrayType(StringType()))
def matched_ids_of(details: pd.Series) -> pd.Series:
    return details.map(matched_ids, na_action=None)


def vertex(text: Column) -> Column:
    """16 bytes of an id text, null if it holds no 32 hex digits."""
    digits = F.regexp_replace(F.regexp_extract(F.lower(text), UUID.pattern, 0), "-", "")
    return F.when(digits != "", F.unhex(digits))


def id_text(v: Column) -> Column:
    """The canonical spelling of 16 bytes as an id."""
    h = F.lower(F.hex(v))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def image_links(images: DataFrame, runs: DataFrame) -> DataFrame:
    """Links (a, b) that the duplicate checks of reports and re-runs state between existing images."""
    in_reports = images.select(F.col("id").alias("image_id"), F.explode("analysis_result.checks").alias("c")).where(F.col("c.check") == "duplicate_detection")
    details = in_reports.select("image_id", F.col("c.details_json").alias("details")).unionByName(
        runs.where(F.col("check_name") == "duplicate_detection").select("image_id", F.col("details_json").alias("details"))
    )
    # A text that names neither kind, not even with escaped letters, states no link and is not parsed.
    text = F.col("details")
    telling = details.where(text.contains("\\u") | text.contains(LINK_TYPES[0]) | text.contains(LINK_TYPES[1]))
    stated = telling.select(vertex(F.col("image_id")).alias("a"), F.explode(matched_ids_of("details")).alias("other"))
    scratch = Scratch(images.sparkSession, "links")
    links, n = scratch.write_counted(undirected(stated.select("a", F.unhex("other").alias("b"))), "stated")
    known = images.select(vertex(F.col("id")).alias("v")).where(F.col("v").isNotNull())
    for end, other in (("a", "b"), ("b", "a")):
        mine, theirs = salted(links, known.withColumnRenamed("v", end), end, F.col(other), n["n"])
        links = mine.join(theirs, [end, "_salt"], "left_semi").select("a", "b")
    return links


def undirected(links: DataFrame) -> DataFrame:
    """Each link once, the smaller end first, without nulls and loops."""
    return links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _carried(links: DataFrame, names: DataFrame, total: int | None) -> DataFrame:
    """Links with each end replaced by its label; an end without one stays. Without a total no vertex has many links."""
    for end, other in (("a", "b"), ("b", "a")):
        mine, theirs, on = links, names.withColumnRenamed("v", end), [end]
        if total is not None:
            (mine, theirs), on = salted(mine, theirs, end, F.col(other), total), [end, "_salt"]
        links = mine.join(theirs, on, "left").select(F.coalesce("label", end).alias(end), other)
    return undirected(links)


def _composed(first: DataFrame, then: DataFrame, total: int | None) -> DataFrame:
    """Labels followed by the labels of the labels, where there are any; ``total`` is about the number of ``first``."""
    mine, theirs, on = first, then.select(F.col("v").alias("label"), F.col("label").alias("next")), ["label"]
    if total is not None:
        (mine, theirs), on = salted(mine, theirs, "label", F.col("v"), total), ["label", "_salt"]
    return mine.join(theirs, on, "left").select("v", F.coalesce("next", "label").alias("label"))


def _spread(scratch: Scratch, links: DataFrame, n: int, name: str, chains: bool = False) -> DataFrame:
    """(v, label) with the smallest vertex of each component as label. In chains a label is adopted by few in a round."""
    labels, most, k = None, n, 0
    while n:
        total = None if chains else n
        lower = _both_ways(links).groupBy(F.col("a").alias("v")).agg(F.min("b").alias("label")).select("v", F.least("v", "label").alias("label"))
        step = scratch.write(_composed(lower, lower, total), f"{name}-step-{k}")
        labels = step if labels is None else _composed(labels, step, most)
        links, met = scratch.write_counted(_carried(links, step, total), f"{name}-left-{k}")
        n, k = met["n"], k + 1
    return links.select(F.col("a").alias("v"), F.col("b").alias("label")) if labels is None else scratch.write(labels, name)


def _chains(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(v, label) of the vertices of chains."""
    narrow = _both_ways(links).groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= CHAIN).select(F.col("a").alias("v"))
    inner = links
    for end in ("a", "b"):
        inner = inner.join(narrow.withColumnRenamed("v", end), end, "left_semi")
    inner, n = scratch.write_counted(inner.select("a", "b"), "chains")
    return _spread(scratch, inner, n["n"], "chain", chains=True)


def _peel(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(v) of the component around the vertex of highest degree."""
    ways = _both_ways(links)
    top = ways.groupBy("a").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "a").select(F.col("a").alias("v")).head().v
    frontier = links.sparkSession.createDataFrame([(bytes(top),)], "v binary")
    reached, before, k, met = frontier, frontier.limit(0), 0, 1
    while met:
        ahead = ways.join(frontier.withColumnRenamed("v", "a"), "a", "left_semi").select(F.col("b").alias("v")).distinct()
        k += 1
        new, n = scratch.write_counted(ahead.join(frontier.union(before), "v", "left_anti"), f"reached-{k}")
        before, frontier, met = frontier, new, n["n"]
        reached = reached.union(new)
        # The links of the start, which may be a great part of all, are followed once.
        ways = ways.where((F.col("a") != F.lit(top)) & (F.col("b") != F.lit(top)))
    return reached


def components(links: DataFrame) -> DataFrame:
    """(v, label) of every linked vertex; the label is the smallest vertex of its component."""
    scratch = Scratch(links.sparkSession, "groups")
    links, n = scratch.write_counted(undirected(links), "links")
    if not n["n"]:
        return links.select(F.col("a").alias("v"), F.col("b").alias("label"))
    total = n["n"]
    chains = _chains(scratch, links)
    short, left = scratch.write_counted(_carried(links, chains, total), "short")
    vertices = _both_ways(links).select(F.col("a").alias("v")).distinct()
    labels = vertices.join(chains, "v", "left").select("v", F.coalesce("label", "v").alias("label"))
    if not left["n"]:
        return labels
    giant = _peel(scratch, short)
    rest, left = scratch.write_counted(short.join(giant.withColumnRenamed("v", "a"), "a", "left_anti"), "rest")
    small = _spread(scratch, rest, left["n"], "small")
    # One row of one aggregate: the giant's smallest vertex.
    named = giant.join(F.broadcast(giant.agg(F.min("v").alias("label"))))
    return _composed(scratch.write(labels, "labels"), scratch.write(named.union(small), "named"), total)
