"""Evaluation passages leaking into documents: a prefix-filtered set join with exact verification.

Speech. A document's cues are read as one sequence of words: time lines and cue numbers, markup,
sound descriptions and speaker labels go, look-alike characters get one form, letter case and
punctuation go, and a word broken at a line end with a hyphen is joined again. Text between stars or notes
may be a description or speech: both readings count.

Join. A leak is a window of 12 consecutive words of a passage (the whole passage if it is
shorter) of which at most two are misread in the document. A misread word differs by at most two characters,
or is split in two, or joined with the next.
1. The shingles are pairs of adjacent words. A misread word spoils at most three of a window's 11 (two words joined
   do), so at least 5 are in the document, and of any 7 of them at least one. Where a short passage has too
   few pairs for that, its shingles are the single words, of which a misread spoils at most two.
2. Shingles are ordered by rarity: in how many documents each occurs, counted over all
   documents. The 7 rarest shingles of a window are its necessary prefix.
3. The documents are joined with the prefixes. A pair is a candidate only if the document holds
   at least as many different shingles of the passage as a window must share (the length bound), and is verified only where
   shingles lie at the same places in both (the positional bound).
4. Verification runs over the windows word by word, with at most two misread words.

The documents are read and brought to words once; the words are written and scanned twice for each block of
passages. A block holds a bounded number of characters, so what is sent to the workers is bounded however
many or long the passages are; only one passage larger than that makes a block of its own size. No scan shuffles a text.

A null or empty text or passage leaks nothing. Repeated documents and equal passages each get
their own row. Texts of any length are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.skeleton import LookAlikes, look_alikes
from frameloom.session import Scratch

WINDOW = 12
MISREAD = 2
#: Characters that a misread word differs in at most, and adjacent pairs or single words that one spoils at most.
CHARACTERS = 2
SPOILT_PAIRS, SPOILT_WORDS = 3, 2
#: Characters of the passages of one block.
BLOCK = 4_000_000

#: Brackets end within their cue: at the next bracket or blank line they are no description.
SOUND = re.compile(r"\[(?:[^\[\]\n]|\n(?!\s*\n))*\]|\((?:[^()\n]|\n(?!\s*\n))*\)")
MARKUP = re.compile(r"</?[^\W\d_][^<>\n]*>|\{[^{}\n]*\}")
LABEL = re.compile(r"[-\s]*[^\W\d_a-z][^a-z:0-9]*:\s")
#: A number, misread or not, in the place of a cue number.
CUE_NUMBER = re.compile(r"\W*[\dlIOo|SBZ]+\W*")
#: The hyphen first, then what must stand before it: so the search can jump to hyphens.
BROKEN = re.compile(r"-(?<=\w-)\s*(?=\w)")
WORD = re.compile(r"[^\W_]+")
APOSTROPHES = "'`\u00b4"


class Speech:
    """What texts speak, under one table of look-alike characters."""

    def __init__(self, alike: LookAlikes):
        self.alike = alike
        note = re.escape(alike.skeleton("\u266a"))
        #: Perhaps descriptions: between notes, or between stars.
        self.between = re.compile(rf"{note}(?:(?!{note})[^\n])*{note}|\*[^*\n]*\*")

    def _cleaned(self, text: str) -> str:
        """The text without time lines, cue numbers, labels, markup and bracketed descriptions."""
        text = self.alike.skeleton(text)
        if ":" in text:
            kept: list[str] = []
            for line in text.split("\n"):
                if ":" in line:
                    if "->" in line:
                        if kept and (kept[-1].isdigit() or (CUE_NUMBER.fullmatch(kept[-1]) and (len(kept) == 1 or not kept[-2].strip()))):
                            kept.pop()
                        continue
                    if label := LABEL.match(MARKUP.sub("", line) + " "):
                        line = MARKUP.sub("", line)[label.end() :]
                kept.append(line)
            text = "\n".join(kept)
        if "<" in text or "{" in text:
            text = MARKUP.sub("", text)
        return SOUND.sub(" ", text)

    @staticmethod
    def _words(text: str) -> list[str]:
        if "-" in text:
            text = BROKEN.sub("", text)
        for mark in APOSTROPHES:
            text = text.replace(mark, "")
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return WORD.findall(text.lower())

    def words(self, text: str | None) -> list[str]:
        """The words of a text, those between stars or notes among them."""
        return self._words(self._cleaned(text)) if text else []

    def readings(self, text: str | None) -> list[list[str]]:
        """The words without what stands between stars or notes, and, where that changes them, with it."""
        if not text:
            return []
        text = self._cleaned(text)
        every = self._words(text)
        fewer = self._words(self.between.sub(" ", text))
        return [r for r in ([every] if fewer == every else [fewer, every]) if r]


def _edits(a: str, b: str, most: int) -> int:
    """Edit distance of two words, or more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    if min(len(a), len(b)) > 2 * most + 1:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def misread(word: str, seen: str) -> bool:
    """Whether ``seen`` can be ``word`` with a character or two misread."""
    return word == seen or _edits(word, seen, CHARACTERS) <= CHARACTERS


class Item:
    """One passage and what its windows require."""

    def __init__(self, item_id: int, words: list[str]):
        self.item_id, self.words = item_id, words
        n = len(self.words)
        self.window = min(WINDOW, n)
        self.misread = MISREAD if self.window == WINDOW else round(MISREAD * self.window / WINDOW)
        pairs = self.window - 1
        self.single = pairs - SPOILT_PAIRS * self.misread < 1
        self.size, spoilt = (self.window, SPOILT_WORDS) if self.single else (pairs, SPOILT_PAIRS)
        self.shingles = [(w, "") for w in self.words] if self.single else list(zip(self.words, self.words[1:]))
        self.places: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i, s in enumerate(self.shingles):
            self.places[s].append(i)
        self.prefix = min(self.size, spoilt * self.misread + 1)
        #: Shingles a window shares at least; windows may repeat one, so a lower bound on different ones.
        self.shared = max(1, self.size - spoilt * self.misread)
        self.needed = min((max(1, len(set(self.shingles[s : s + self.size])) - spoilt * self.misread) for s in range(len(self.shingles) - self.size + 1)), default=1)

    def prefixes(self, rarity: dict[tuple[str, str], int]) -> set[tuple[str, str]]:
        """The necessary shingles of all windows: of each the rarest few, ties by the shingle itself."""
        out: set[tuple[str, str]] = set()
        for s in range(len(self.shingles) - self.size + 1):
            out.update(sorted(self.shingles[s : s + self.size], key=lambda x: (rarity.get(x, 0), x))[: self.prefix])
        return out

    def _from(self, i: int, end: int, doc: list[str], d: int, left: int) -> bool:
        """Whether words i..end of the passage are spoken from word d on with at most ``left`` misread."""
        mine = self.words
        while i < end:
            if d >= len(doc):
                return False
            if mine[i] == doc[d]:
                i, d = i + 1, d + 1
                continue
            if not left:
                return False
            if d + 1 < len(doc) and misread(mine[i], doc[d] + doc[d + 1]) and self._from(i + 1, end, doc, d + 2, left - 1):
                return True
            if i + 1 < end and misread(mine[i] + mine[i + 1], doc[d]) and self._from(i + 2, end, doc, d + 1, left - 1):
                return True
            if not misread(mine[i], doc[d]):
                return False
            i, d, left = i + 1, d + 1, left - 1
        return True

    def spoken(self, doc: list[str], where: dict[tuple[str, str], list[int]]) -> bool:
        """Exact verification over the windows with enough shingles at matching places."""
        at: dict[int, list[int]] = defaultdict(list)
        for s, mine in self.places.items():
            for d in where.get(s, ()):
                for i in mine:
                    at[d - i].append(i)
        tried: set[tuple[int, int]] = set()
        for offset in at:
            # A split or joined word moves the rest by one; there are at most as many as misread words.
            near = sorted({i for k in range(-self.misread, self.misread + 1) for i in at.get(offset + k, ())})
            if len(near) < self.shared:
                continue
            for s in range(max(0, near[0] - self.size + 1), min(len(self.words) - self.window, near[-1]) + 1):
                if bisect_left(near, s + self.size) - bisect_left(near, s) < self.shared:
                    continue
                for start in range(max(0, s + offset - self.misread), s + offset + self.misread + 1):
                    if (s, start) not in tried:
                        tried.add((s, start))
                        if self._from(s, s + self.window, doc, start, self.misread):
                            return True
        return False


def _shingles(doc: list[str], single: frozenset[str]) -> set[tuple[str, str]]:
    held = set(zip(doc, doc[1:]))
    if single:
        held.update((w, "") for w in single.intersection(doc))
    return held


def spoken_words(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, said): the readings of each document that speaks, each as its words with blanks between; one pass, no shuffle."""
    # Bounded by the number of characters there are.
    shared = documents.sparkSession.sparkContext.broadcast(look_alikes(documents.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speech = Speech(shared.value)
        for batch in batches:
            ids, said = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if readings := speech.readings(text):
                    ids.append(doc_id)
                    said.append([" ".join(r) for r in readings])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(said, pa.list_(pa.string()))], names=["doc_id", "said"])

    chosen = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return chosen.mapInArrow(run, "doc_id bigint, said array<string>")


def rarity(said: DataFrame, shingles: frozenset[tuple[str, str]]) -> dict[tuple[str, str], int]:
    """In how many of all documents each of a block's shingles occurs. One row for each of them comes back."""
    names = said.sparkSession.sparkContext.broadcast(shingles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = frozenset(a for a, b in names.value if not b)
        seen: Counter = Counter()
        for batch in batches:
            for readings in batch.column(0).to_pylist():
                seen.update(names.value & set().union(*[_shingles(r.split(" "), single) for r in readings]))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in seen], pa.string()), pa.array([b for _, b in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["a", "b", "n"])

    counted = said.select("said").mapInArrow(run, "a string, b string, n bigint")
    return {(r.a, r.b): r.n for r in counted.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}


def _leaking(doc: list[str], items: list[Item], by: dict[tuple[str, str], list[int]], prefixes: frozenset, single: frozenset[str], known: set[int]) -> Iterator[int]:
    """Places of the items that one reading speaks, but for the known ones."""
    held = _shingles(doc, single)
    met = held & prefixes
    where: dict[tuple[str, str], list[int]] | None = None
    for k in {k for s in met for k in by[s]} - known:
        item = items[k]
        if len(item.places.keys() & held) < item.needed:
            continue
        if where is None:
            where = defaultdict(list)
            for d, s in enumerate(zip(doc, doc[1:])):
                where[s].append(d)
            for d, w in enumerate(doc):
                if w in single:
                    where[(w, "")].append(d)
        if item.spoken(doc, where):
            yield k


def _block(said: DataFrame, items: list[Item]) -> DataFrame:
    rare = rarity(said, frozenset(s for i in items for s in i.shingles))
    by_prefix: dict[tuple[str, str], list[int]] = defaultdict(list)
    for k, item in enumerate(items):
        for s in item.prefixes(rare):
            by_prefix[s].append(k)
    shared = said.sparkSession.sparkContext.broadcast((items, dict(by_prefix)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, by = shared.value
        prefixes = frozenset(by)
        single = frozenset(w for i in mine if i.single for w in i.words)
        for batch in batches:
            docs, leaked = [], []
            for doc_id, readings in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                met: set[int] = set()
                for text in readings:
                    met.update(list(_leaking(text.split(" "), mine, by, prefixes, single, met)))
                docs += [doc_id] * len(met)
                leaked += [mine[k].item_id for k in sorted(met)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(leaked, pa.int64())], names=["doc_id", "item_id"])

    return said.mapInArrow(run, "doc_id bigint, item_id bigint")


def blocks_of(items: DataFrame, bound: int = BLOCK) -> DataFrame:
    """Adds ``block``: by hash, as many as keep the characters of each block within the bound, or each passage alone."""
    sized = items.withColumn("_size", F.length("passage"))
    total = sized.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("c"), F.count(F.lit(1)).alias("n"), F.coalesce(F.max("_size"), F.lit(0)).alias("most")).first()
    blocks = max(1, -(-total.c // bound))
    while True:
        placed = sized.withColumn("block", F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)))
        heavy = placed.groupBy("block").agg(F.sum("_size").alias("c")).agg(F.max("c")).first()[0] or 0
        if heavy <= max(bound, total.most) or blocks > 1000 * total.n:
            return placed.drop("_size")
        blocks *= 2


def leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", bound: int = BLOCK) -> DataFrame:
    """(doc_id, item_id) of every document and passage it speaks, fully or in part."""
    spark = documents.sparkSession
    speech = Speech(look_alikes(spark))
    chosen = items.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(passage_col).cast("string").alias("passage")).where("item_id is not null and passage is not null")
    scratch = Scratch(spark, "leaks")
    placed = scratch.write(blocks_of(chosen, bound), "items")
    found, said = [], None
    for (block,) in placed.select("block").distinct().orderBy("block").collect():
        held = [i for i in (Item(r.item_id, speech.words(r.passage)) for r in placed.where(F.col("block") == block).collect()) if i.words]
        if held:
            said = scratch.write(spoken_words(documents, id_col, text_col), "said") if said is None else said
            found.append(_block(said, held))
    if not found:
        return documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("item_id")).limit(0)
    return reduce(DataFrame.union, found)


def leaked_items(found: DataFrame, items: DataFrame) -> DataFrame:
    """For each item: in how many documents it leaked; 0 for none."""
    counts = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"))
    return items.select("item_id", "task", "split_name", "lang").join(counts, "item_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))
