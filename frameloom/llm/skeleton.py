"""One form for texts that look alike: decompose, replace by look-alike prototype, decompose again.

Two texts look the same if their skeletons are equal. The skeleton
- decomposes compatibility variants (width, ligatures, signs) and separates accents,
- turns every kind of blank into a space and every kind of line end into a line feed,
- drops what leaves no ink (zero-width and formatting characters, controls),
- replaces a character by the prototype the public Unicode data on confusable characters give it (UTS #39).
ASCII characters are never merged, nor are letters with and without accent, nor the cases.

The data are those of the ICU library that Spark itself ships with (77.1, Unicode 16.0, in Spark 4.1), read on
the driver for all assigned characters: some 4,300 entries, bounded by the number of characters. They put some ASCII
characters into one class (I, l, 1 and |; O and 0; ' and `), which here stay apart: a character of such
a class gets the ASCII character of its own case or kind. Combining marks stay as they are.

A null text has no skeleton; neither has a text without a visible character. Empty tables
give empty results. Equal texts are never a pair, whatever their number. Repeated rows of one document
repeat its pairs.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.session import Scratch

#: Characters that are their own prototype and need no look-up.
PLAIN = frozenset(map(chr, range(0x20, 0x7F))) | {"\n"}
#: Shown as blanks though they are no separators: tabulators, and the empty Braille pattern.
ALSO_BLANK = "\t\x0b\x0c\u2800"

# Letters of another script with a Latin shape that the data lack or give to another letter.
MORE_SHAPES = {"Һ": "h", "Ԛ": "Q", "ӏ": "l"}


def _no_ink(c: str) -> str | None:
    """What stands for a blank, a line end or a character without ink; None for any other."""
    kind = unicodedata.category(c)
    if kind == "Zs" or c in ALSO_BLANK:
        return " "
    if kind in ("Zl", "Zp"):
        return "\n"
    return "" if kind in ("Cf", "Cc") and c != "\n" else None


def _of_its_kind(c: str, among: list[str]) -> str:
    """The ASCII character of a class that has the case or kind of ``c``."""
    kind = unicodedata.category(c)

    def rank(a: str) -> tuple[int, str]:
        if kind in ("Lu", "Lt"):
            return (0 if a.isupper() else 1), a
        if kind[0] == "N":
            return (0 if a.isdigit() else 1), a
        if kind[0] == "L":
            return (0 if a.islower() else 1 if a.isalpha() else 2), a
        return (0 if not a.isalnum() else 1), a

    return min(among, key=rank)


def public_classes(spark: SparkSession) -> dict[str, str]:
    """Assigned character → prototype, from the library's data; only characters that neither decompose canonically nor into ASCII."""
    checker = getattr(spark.sparkContext._jvm, "com").ibm.icu.text.SpoofChecker.Builder().build()
    held = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) not in ("Cn", "Co", "Cs") and _no_ink(c) is None and unicodedata.normalize("NFD", c) == c and not unicodedata.normalize("NFKD", c).isascii()]
    plain = sorted(PLAIN - {"\n"})
    made = checker.getSkeleton("\n".join(plain + held)).split("\n")
    if len(made) != len(plain) + len(held):
        raise RuntimeError("the look-alike data can't be read character by character")
    ascii_of: dict[str, list[str]] = defaultdict(list)
    for a, prototype in zip(plain, made):
        ascii_of[prototype].append(a)
    table = {}
    for c, prototype in zip(held, made[len(plain) :]):
        if unicodedata.category(c)[0] != "M" or prototype == "":
            among = ascii_of.get(prototype)
            prototype = _of_its_kind(c, among) if among else prototype
            if prototype != c:
                table[c] = prototype
    return table | MORE_SHAPES


class LookAlikes(dict):
    """Character → its skeleton, worked out once for each character a worker meets."""

    def __init__(self, table: dict[str, str]):
        super().__init__()
        self.table = table

    def __reduce__(self):
        return LookAlikes, (self.table,)

    def _step(self, c: str) -> str:
        if c in PLAIN:
            return c
        bare = _no_ink(c)
        if bare is not None:
            return bare
        apart = unicodedata.normalize("NFKD", c)
        if apart.isascii():
            return apart
        return unicodedata.normalize("NFKD", self.table[c]) if c in self.table else apart

    def __missing__(self, c: str) -> str:
        text = self._step(c)
        while (after := "".join(map(self._step, text))) != text:
            text = after
        self[c] = text
        return text

    def skeleton(self, text: str) -> str:
        """Replaces each distinct unusual character over the whole text; the last step puts marks in canonical order."""
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        if text.isascii() and text.isprintable():
            return text
        # A skeleton is its own skeleton, so the order of replacements doesn't matter.
        for c in set(text) - PLAIN:
            plain = self[c]
            if plain != c:
                text = text.replace(c, plain)
        return text if text.isascii() else unicodedata.normalize("NFKD", text)


_made: dict[str, LookAlikes] = {}


def look_alikes(spark: SparkSession) -> LookAlikes:
    """The table of a session; read once."""
    key = spark.sparkContext.applicationId
    if key not in _made:
        _made[key] = LookAlikes(public_classes(spark))
    return _made[key]


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def forms(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, form, own): 128-bit digests of the skeleton and of the text itself, one pass, no shuffle.

    Documents whose text has nothing visible are left out.
    """

    # Bounded by the number of characters there are.
    shared = documents.sparkSession.sparkContext.broadcast(look_alikes(documents.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skeleton = shared.value.skeleton
        for batch in batches:
            ids, form, own = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                plain = skeleton(text)
                if plain.strip():
                    ids.append(doc)
                    form.append(_digest(plain))
                    own.append(_digest(text))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(form, pa.binary()), pa.array(own, pa.binary())], names=["doc_id", "form", "own"])

    chosen = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return chosen.mapInArrow(run, "doc_id bigint, form binary, own binary")


def spellings(made: DataFrame) -> DataFrame:
    """(form, own) of the forms that have more than one spelling."""
    distinct = made.select("form", "own").distinct()
    several = distinct.groupBy("form").agg(F.count(F.lit(1)).alias("spellings")).where("spellings > 1")
    return distinct.join(several, "form")


def look_alike_pairs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), a < b, of equal skeletons and different texts.

    Copies of one text are never paired; a group is expanded by a join of its spellings, so that
    a form with a single spelling, however often copied, costs nothing here.
    """
    # The digests are a few bytes a document: written once, the texts are read and decomposed once.
    made = Scratch(documents.sparkSession, "forms").write(forms(documents, id_col, text_col), "forms")
    several = spellings(made).select("form", "own", "spellings")
    rows = made.join(several, ["form", "own"]).select("doc_id", "form", "own")
    other = rows.select(F.col("doc_id").alias("doc_id_b"), F.col("form").alias("f"), F.col("own").alias("o"))
    pairs = rows.join(other, (F.col("form") == F.col("f")) & (F.col("own") != F.col("o")) & (F.col("doc_id") < F.col("doc_id_b")))
    return pairs.select(F.col("doc_id").alias("doc_id_a"), "doc_id_b")


def look_alike_classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document of a form with several spellings: its class (smallest id), spellings and size."""
    made = Scratch(documents.sparkSession, "forms").write(forms(documents, id_col, text_col), "forms")
    classes = made.groupBy("form").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("members"), F.countDistinct("own").alias("spellings")).where("spellings > 1")
    return made.join(classes, "form").select("doc_id", "class_id", "spellings", "members")
