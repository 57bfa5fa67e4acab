import random

import pytest

from frameloom.llm import leaks as L
from frameloom.llm.skeleton import look_alikes

PASSAGE = "The granary, once relocated near Tork, now holds wool for Beln. In Rish the kiln kept 48 bars of slate beneath Mibella's stair."
SHORT = "En Themor el faro guardó 52 cajas de miel para Esla."
SPOKEN = PASSAGE.replace(",", "").replace(".", "").split()


def cues(words, per_line=4, start=3):
    out = []
    for i in range(0, len(words), per_line):
        out.append(f"{start + i}\n00:00:{i + 10:02},100 --> 00:00:{i + 12:02},200\n" + " ".join(words[i : i + per_line]) + "\n")
    return "\n".join(out)


@pytest.fixture(scope="module")
def speech(spark):
    return L.Speech(look_alikes(spark))


@pytest.fixture(scope="module")
def spoken(speech):
    def judge(text, passage=PASSAGE):
        item = L.Item(1, speech.words(passage))
        for doc in speech.readings(text):
            where = {}
            for i, s in enumerate([*zip(doc, doc[1:])] if not item.single else [(w, "") for w in doc]):
                where.setdefault(s, []).append(i)
            if item.spoken(doc, where):
                return True
        return False

    return judge


def replaced(changes, words=SPOKEN):
    out = list(words)
    for i, w in changes.items():
        out[i] = w
    return " ".join(out)


@pytest.mark.parametrize(
    "text",
    [
        PASSAGE, PASSAGE.upper(), cues(SPOKEN), cues(SPOKEN).replace("\n", "\r\n"), " ".join(SPOKEN[3:15]),
        cues(SPOKEN).replace("relocated", "relo-\ncated"), cues(SPOKEN, 3).replace("near", "<i>near</i>"), "\n".join(SPOKEN),
        cues(SPOKEN).replace("now", "[DOOR CREAKS]\n\n9\n00:00:50,000 --> 00:00:51,000\nnow"), cues(SPOKEN).replace("wool", "(phone rings) wool").replace("Tork", "* laughs * Tork"),
        replaced({1: "gran4ry", 8: "woo1"}, SPOKEN[:12]), replaced({4: "ncar", 7: "hoIds"}, SPOKEN[:12]), PASSAGE.replace("o", "ο").replace("a", "а").replace("fi", "ﬁ"),
        "Ｔｈｅ ｇｒａｎａｒｙ ｏｎｃｅ relo​cated near Tork now holds wool for Beln In Rish", "gran-\n\n44\n00:00:01,000 --> 00:00:02,000\nary once relocated near Tork now holds wool for Beln In Rish the",
        " ".join(SPOKEN[:6]) + "\n\n5\n00:00:01,000 --> 00:00:02,000\nORRA: " + " ".join(SPOKEN[6:12]), "The gran ary once relocated near Tork now holds wool for Beln in",
        "The granaryonce relocated nearTork now holds wool for Beln in", cues(SPOKEN).replace("now", "[" + "A VERY LONG NOISE " * 20 + "]\n\n9\n00:00:50,000 --> 00:00:51,000\nnow"),
        cues(SPOKEN).replace("wool", "♪ soft music ♪ wool"), cues(SPOKEN).replace("wool", "*wool*"), "♪ " + " ".join(SPOKEN[:12]) + " ♪", "I *" + " ".join(SPOKEN[:12]) + "* now",
    ],
)
def test_spoken(spoken, text):
    assert spoken(text)


@pytest.mark.parametrize(
    "text",
    [
        "", " ".join(SPOKEN[3:14]) + " else", " ".join(SPOKEN[::-1]), replaced({2: "hammer", 5: "basket", 8: "candle", 11: "river", 14: "wagon", 17: "mirror", 20: "tunnel"}),
        replaced({1: "gran4ry", 4: "ncar", 8: "woo1"}, SPOKEN[:12]), replaced({1: "seedling", 8: "amber"}, SPOKEN[:12]), " ".join(w + " um" for w in SPOKEN),
    ],
)
def test_not_spoken(spoken, text):
    assert not spoken(text)


def test_short_passage_needs_all_of_it(spoken):
    assert spoken(SHORT, SHORT) and spoken(SHORT.replace("faro", "far0").replace("guardó", "guardo"), SHORT)
    assert not spoken("En Themor el faro guardó 52 cajas de miel para", SHORT)


def garbled(rng, words, n):
    """Up to n words changed in one of the ways that count as misread."""
    out = list(words)
    for _ in range(n):
        k = rng.randrange(len(out))
        way = rng.choice(["one", "two", "drop", "add", "split", "join"])
        w = list(out[k])
        if way == "one":
            w[rng.randrange(len(w))] = "x"
        elif way == "two":
            for _ in range(2):
                w[rng.randrange(len(w))] = "q"
        elif way == "drop" and len(w) > 1:
            del w[rng.randrange(len(w))]
        elif way == "add":
            w.insert(rng.randrange(len(w) + 1), "z")
        elif way == "split" and len(w) > 1:
            w.insert(rng.randrange(1, len(w)), " ")
        elif way == "join" and k + 1 < len(out):
            w += out.pop(k + 1)
        out[k] = "".join(w)
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_filter_loses_nothing(spark, speech, seed):
    """Against plain window search: every document with every item at every place, over all ways of misreading."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" if i % 3 else f"word{i}" for i in range(60)] + ["a", "in", "of", "the"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 11, 12, 13, 20, 30])))) for i in range(40)] + [(90, None), (91, ""), (92, "...")]
    items.append((93, items[0][1]))
    docs = []
    for d in range(200):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        part = rng.choice(items[:40])[1].split()
        at = rng.randrange(max(1, len(part) - 12) if len(part) > 12 else 1)
        part = garbled(rng, part[at : at + rng.choice([10, 11, 12, 13])], rng.randrange(4))
        docs.append((d, " ".join(words[:10] + part + words[10:]), "extra"))
    docs += [(900, None, None), (901, "", None), (902, docs[0][1], None)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    chosen = spark.createDataFrame(items, "item_id bigint, passage string")
    made = [L.Item(i, speech.words(p)) for i, p in items if p]
    want = set()
    for d, text, _ in docs:
        for doc in speech.readings(text):
            for item in (m for m in made if m.words):
                if any(item._from(s, s + item.window, doc, p, item.misread) for s in range(len(item.words) - item.window + 1) for p in range(len(doc))):
                    want.add((d, item.item_id))
    assert len(want) > 100 and sorted(tuple(r) for r in L.leaks(table, chosen).collect()) == sorted(want)
    assert {tuple(r) for r in L.leaks(table, chosen, bound=200).collect()} == want


def test_blocks_stay_within_the_bound(spark):
    items = spark.createDataFrame([(i, "x" * (1 + i % 50)) for i in range(300)] + [(999, "y" * 2000)], "item_id bigint, passage string")
    placed = L.blocks_of(items, 500)
    sizes = [r.c for r in placed.groupBy("block").agg(L.F.sum(L.F.length("passage")).alias("c")).collect()]
    assert placed.count() == 301 and max(sizes) <= 2000


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, PASSAGE)], "item_id bigint, passage string")
    assert L.leaks(docs, items).count() == 0
    assert L.leaks(spark.createDataFrame([(1, PASSAGE)], "doc_id bigint, text string"), items.limit(0)).count() == 0


def test_very_long_text(spoken):
    assert spoken("blah " * 200_000 + PASSAGE + " blah" * 200_000)


@pytest.mark.parametrize("word,seen,yes", [("granary", "gran4ry", True), ("the", "thx", True), ("near", "ncor", True), ("dismor", "disrnor", True), ("we", "wc", True), ("near", "hammer", False), ("how", "bow", True), ("granary", "grxnqrz", False), ("cedar", "cdear", True)])
def test_misread(word, seen, yes):
    assert L.misread(word, seen) is yes
