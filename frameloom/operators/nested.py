"""Deeply nested reports as related flat tables, with Merkle identities of their subtrees.

Every object and list inside readable details is canonicalised (keys sorted, values by type) and
hashed bottom-up from the hashes of its children, 128 bits wide. Equal hash means equal subtree, so
a subtree is stored once however many reports hold it:

- ``reports``  (image_id, overall_status, n_issues, n_checks, confidence_score): one row a report
- ``checks``   (image_id, check_pos, check_name, passed, severity, message): its elements
- ``details``  (image_id, check_pos, node): each readable detail tree names its check and its root
- ``objects``  (node, kind, n_children): each distinct object or list once
- ``bridge``   (parent, ordinal, key, child, value_type, value): its children in order, by key or by
  position; ``child`` names a subtree, else the scalar itself stands there
- ``occurrences`` (image_id, check_pos, prefix, node): every place at which a subtree with scalars stands
- ``values``   (image_id, check_pos, path, value_type, value): every scalar, from occurrences and bridge

The walk from roots down to all occurrences doubles its reach each round: a table of steps of length
2**k is joined with itself, so that the rounds follow the logarithm of the depth. A step leads from a subtree to the next
ones below that hold scalars of their own, through those that only hold subtrees.

Defined cases. ``check_pos`` counts from 0 and counts null elements. Details are readable if
the text is JSON (NaN and infinities are not), or a JSON string that holds JSON, at any depth and with
numbers of any length. Null, unreadable and scalar details have no tree; empty objects and lists are trees without scalars.
Of a key that repeats within an object the last value holds. Scores that are not a number are null. Reports that
are null have no rows; reports without checks only a report row. Repeated input rows give
repeated rows in ``reports``, ``checks``, ``details`` and what follows from it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions.details import LongNumber, read_details
from frameloom.operators.skew import salted
from frameloom.session import Scratch

#: Bounds of what a worker remembers: characters of texts, and identities of 16 bytes.
MEMO_CHARACTERS = 16_000_000
MEMO_NODES = 400_000
#: Rows of subtrees after which a worker hands on what it has.
FLUSH_CHILDREN = 100_000
DEEPEST = 10_000_000

CHILD = pa.struct([("key", pa.string()), ("child", pa.binary()), ("more", pa.bool_()), ("value_type", pa.string()), ("value", pa.string())])
#: Rows of details have no kind, those of subtrees "object" or "list"; rows of kind "steps" lead from a subtree (node) along a path (key) to others (child).
LAYOUT = pa.schema([("image_id", pa.string()), ("check_pos", pa.int32()), ("node", pa.binary()), ("more", pa.bool_()), ("kind", pa.string()), ("children", pa.list_(CHILD))])
DDL = "image_id string, check_pos int, node binary, more boolean, kind string, children array<struct<key:string,child:binary,more:boolean,value_type:string,value:string>>"


def _clean(text: str) -> str:
    """Text that can be stored as UTF-8: lone surrogates become question marks."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def _scalar(value) -> tuple[str, str | None]:
    kind = type(value)
    if kind is str:
        return "string", value if value.isascii() else _clean(value)
    if kind is bool:
        return "boolean", "true" if value else "false"
    if value is None:
        return "null", None
    return "number", str(value) if kind is LongNumber else repr(value)


class Seen:
    """What is known of a subtree: its identity, whether it and what is below it hold scalars, and the subtrees below that do."""

    __slots__ = ("node", "own", "below")

    def __init__(self, node: bytes, own: bool, below: list[tuple[str, Seen]]):
        self.node, self.own, self.below = node, own, below

    def steps(self) -> list[tuple[str, bytes, bool]]:
        """(path, identity, whether steps go on there) of the nearest subtrees below with scalars of their own."""
        found, path, left = [], [], [(0, step, seen) for step, seen in reversed(self.below)]
        while left:
            depth, step, seen = left.pop()
            path[depth:] = [step]
            if seen.own:
                found.append(("".join(path), seen.node, bool(seen.below)))
            else:
                left += [(depth + 1, s, x) for s, x in reversed(seen.below)]
        return found


class Subtrees:
    """Identities of subtrees, and the rows of those not met before, column by column."""

    def __init__(self):
        self.met: set[bytes] = set()
        self._clear()

    def _clear(self) -> None:
        self.nodes, self.kinds, self.ends = [], [], [0]
        self.columns: dict[str, list] = {f.name: [] for f in CHILD}

    def _row(self, node: bytes, kind: str, **columns: list) -> None:
        n = len(next(iter(columns.values())))
        for name, held in self.columns.items():
            held += columns.get(name) or [None] * n
        self.nodes.append(node)
        self.kinds.append(kind)
        self.ends.append(self.ends[-1] + n)

    def _is_new(self, node: bytes) -> bool:
        if node in self.met:
            return False
        if len(self.met) >= MEMO_NODES:
            self.met.clear()
        self.met.add(node)
        return True

    def add(self, value: dict | list) -> Seen:
        if type(value) is dict:
            children = sorted(value.items())
            keys = [k if k.isascii() else _clean(k) for k, _ in children]
            held = [v for _, v in children]
            own = ["{", *[f"{len(k)}:{k}" for k in keys]]
        else:
            keys, held, own = None, value, ["["]
        types, texts, child, below = [], [], None, []
        for v in held:
            if type(v) is dict or type(v) is list:
                seen = self.add(v)
                if child is None:
                    child = [None] * len(held)
                place = len(types)
                child[place] = seen.node
                if seen.own or seen.below:
                    below.append((f"[{place}]" if keys is None else f".{keys[place]}", seen))
                own.append("#" + seen.node.hex())
                types.append(None)
                texts.append(None)
            else:
                kind, text = _scalar(v)
                own.append(kind if text is None else f"{kind}{len(text)}:{text}")
                types.append(kind)
                texts.append(text)
        node = blake2b("\0".join(own).encode(), digest_size=16).digest()
        made = Seen(node, any(types), below)
        if self._is_new(node):
            self._row(node, "list" if keys is None else "object", value_type=types, value=texts, key=keys, child=child)
            if made.own and below:
                self._steps(made)
        return made

    def root(self, value: dict | list) -> Seen:
        """A tree of its own: the walk starts at it even where it holds subtrees only."""
        made = self.add(value)
        if made.below and not made.own and self._is_new(made.node + b"*"):
            self._steps(made)
        return made

    def _steps(self, made: Seen) -> None:
        paths, nodes, more = map(list, zip(*made.steps()))
        self._row(made.node, "steps", key=paths, child=nodes, more=more)

    def waiting(self) -> int:
        return self.ends[-1]

    def take(self) -> pa.RecordBatch | None:
        """The rows of new subtrees, which are then forgotten; their identities are not."""
        if not self.nodes:
            return None
        held = pa.StructArray.from_arrays([pa.array(self.columns[f.name], f.type) for f in CHILD], fields=list(CHILD))
        children = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), held)
        made = _batch({"node": pa.array(self.nodes, pa.binary()), "kind": pa.array(self.kinds, pa.string()), "children": children})
        self._clear()
        return made


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    n = len(columns["node"])
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in LAYOUT], schema=LAYOUT)


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of details (kind is null) and of subtrees; the calls go as deep as a tree, on the heap and not on the stack."""
    limit = sys.getrecursionlimit()
    trees, known, characters = Subtrees(), {}, 0

    def read(text: str) -> tuple | None:
        tree = read_details(text)
        if tree is None:
            return None
        sys.setrecursionlimit(DEEPEST)
        try:
            seen = trees.root(tree)
        finally:
            sys.setrecursionlimit(limit)
        return seen.node, bool(seen.below)

    for batch in batches:
        images, places, roots = [], [], []
        for image_id, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for pos, text in enumerate(texts):
                if text is None:
                    continue
                found = known.get(text, 0)
                if found == 0:
                    characters += len(text)
                    if characters > MEMO_CHARACTERS:
                        known.clear()
                        characters = len(text)
                    known[text] = found = read(text)
                    if trees.waiting() > FLUSH_CHILDREN:
                        yield trees.take()
                if found is not None:
                    images.append(image_id)
                    places.append(pos)
                    roots.append(found)
        if roots:
            yield _batch({n: pa.array(c, LAYOUT.field(n).type) for n, c in zip(("image_id", "check_pos", "node", "more"), (images, places, *zip(*roots)))})
        made = trees.take()
        if made is not None:
            yield made


def _step(key: Column, ordinal: Column) -> Column:
    return F.when(key.isNull(), F.concat(F.lit("["), ordinal.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), key))


class NestedReports:
    """The flat tables of a table of reports. One pass over the details writes all their tables."""

    def __init__(self, rows: DataFrame, id_col: str = "id", report_col: str = "analysis_result"):
        self.rows = rows.select(F.col(id_col).cast("string").alias("image_id"), F.col(report_col).alias("report")).where(F.col("report").isNotNull())
        self.scratch = Scratch(rows.sparkSession, "nested")
        self._written: DataFrame | None = None
        self._occurrences: DataFrame | None = None

    def reports(self) -> DataFrame:
        score = F.col("report.confidence_score")
        return self.rows.select(
            "image_id",
            F.col("report.overall_status").alias("overall_status"),
            F.size(F.coalesce("report.issues_found", F.array().cast("array<string>"))).alias("n_issues"),
            F.when(F.col("report.checks").isNotNull(), F.size("report.checks")).alias("n_checks"),
            F.when(~F.isnan(score), score).alias("confidence_score"),
        )

    def checks(self) -> DataFrame:
        flat = self.rows.select("image_id", F.posexplode("report.checks").alias("check_pos", "c")).where(F.col("c").isNotNull())
        return flat.select("image_id", "check_pos", F.col("c.check").alias("check_name"), "c.passed", "c.severity", "c.message")

    def _raw(self) -> DataFrame:
        if self._written is None:
            texts = self.rows.where(F.col("report.checks").isNotNull()).select("image_id", F.transform("report.checks", lambda c: c["details_json"]).alias("texts"))
            self._written, self._counts = self.scratch.write_counted(texts.mapInArrow(_flatten, DDL), "tables", details=F.count("check_pos"), more=F.count_if(F.col("kind").isNull() & F.col("more")))
        return self._written

    def _met(self) -> DataFrame:
        """Subtrees as tasks met them: one that several tasks met stands there several times."""
        return self._raw().where(F.col("kind").isin("object", "list"))

    def details(self) -> DataFrame:
        return self._raw().where(F.col("kind").isNull()).select("image_id", "check_pos", "node")

    def objects(self) -> DataFrame:
        """Each distinct subtree once: what tasks met apart is brought together by its hash."""
        made = self._met().select("node", "kind", F.size("children.child").alias("n_children"))
        return made.groupBy("node").agg(F.first("kind").alias("kind"), F.first("n_children").alias("n_children"))

    def bridge(self) -> DataFrame:
        once = self._met().select("node", "children").dropDuplicates(["node"])
        rows = once.select(F.col("node").alias("parent"), F.posexplode("children").alias("ordinal", "c"))
        return rows.select("parent", "ordinal", "c.key", "c.child", "c.value_type", "c.value")

    def _steps(self) -> DataFrame:
        """(node, path, to, on) of the steps from each subtree, each once; ``on`` tells whether others follow."""
        met = self._raw().where(F.col("kind") == "steps").select("node", F.arrays_zip("children.key", "children.child", "children.more").alias("c"))
        once = met.groupBy("node").agg(F.first("c").alias("c")).select("node", F.explode("c").alias("c"))
        return once.select("node", F.col("c.key").alias("path"), F.col("c.child").alias("to"), F.col("c.more").alias("on"))

    def occurrences(self) -> DataFrame:
        """(image_id, check_pos, prefix, node) of every root, and of every place below of a subtree that holds scalars of its own."""
        if self._occurrences is not None:
            return self._occurrences
        roots = self._raw().where(F.col("kind").isNull())
        found = roots.select("image_id", "check_pos", F.lit("").alias("prefix"), "node", "more")
        rows, open_, on = self._counts["details"], self._counts["more"], F.count_if("on")
        steps, n = self.scratch.write_counted(self._steps(), "steps-0", on=on)
        k, nothing = 0, F.lit(None).cast("string")
        while n["n"] and open_:
            # One join takes a step from every place reached, and doubles the steps themselves: those have a start instead of an image.
            ways = found.where("more").select("image_id", "check_pos", F.lit(None).cast("binary").alias("start"), "prefix", "node")
            ways = ways.union(steps.where("on").select(nothing, F.lit(None).cast("int"), "node", "path", F.col("to")))
            mine, theirs = salted(ways, steps, "node", F.struct("image_id", "check_pos", "start", "prefix"), open_ + n["on"])
            down = mine.join(theirs, ["node", "_salt"]).select("image_id", "check_pos", "start", F.concat("prefix", "path").alias("prefix"), F.col("to").alias("node"), F.col("on").alias("more"))
            is_step = F.col("start").isNotNull()
            down, met = self.scratch.write_counted(down, f"down-{k}", steps=F.count_if(is_step), on=F.count_if(is_step & F.col("more")), more=F.count_if(~is_step & F.col("more")))
            found = found.union(down.where(~is_step).select(found.columns))
            rows, open_ = rows + met["n"] - met["steps"], open_ + met["more"]
            steps = down.where(is_step).select(F.col("start").alias("node"), F.col("prefix").alias("path"), F.col("node").alias("to"), F.col("more").alias("on"))
            n, k = {"n": met["steps"], "on": met["on"]}, k + 1
        self._occurrences, self._total = found.select("image_id", "check_pos", "prefix", "node"), rows
        return self._occurrences

    def _scalars(self, *fields: str) -> DataFrame:
        """Every occurrence joins the bridge rows of its subtree, of which only the asked-for fields are read."""
        held = F.arrays_zip(*[f"children.{f}" for f in ("key", "value_type", *fields)])
        places = self.occurrences()
        mine, theirs = salted(places, self._met().select("node", held.alias("c")), "node", F.struct("image_id", "check_pos", "prefix"), self._total)
        once = theirs.groupBy("node", "_salt").agg(F.first("c").alias("c"))
        flat = mine.join(once, ["node", "_salt"]).select("image_id", "check_pos", "prefix", F.posexplode("c").alias("ordinal", "c")).where("c.value_type is not null")
        path = F.concat("prefix", _step(F.col("c.key"), F.col("ordinal")))
        return flat.select("image_id", "check_pos", F.when(path.startswith("."), F.substring(path, 2, 2**31 - 1)).otherwise(path).alias("path"), *[F.col(f"c.{f}") for f in ("value_type", *fields)])

    def paths(self) -> DataFrame:
        """(image_id, check_pos, path) of each scalar: ``values`` without reading the values."""
        return self._scalars().select("image_id", "check_pos", "path")

    def values(self) -> DataFrame:
        """(image_id, check_pos, path, value_type, value) of each scalar."""
        return self._scalars("value").select("image_id", "check_pos", "path", "value_type", "value")
