"""The dictionary tagger by its automaton and by joins, against brute force over all words and names; sentences; odd rows."""

import random
import re

import pytest

from tankline.operators import tagger
from tankline.sources import sinks

WIKI = "brand_name string, car_name string, wiki_name string"
PAGES = "id int, brand string, tag string, page_text string"


def plain_words(s):
    return [w for w in re.split(r"[^\w]+", s.lower()) if w]


def sentences_of(text):
    return [w for w in (plain_words(s) for s in re.split(r"[.!?][ \t\n\r\f]+|[\n\r]+", text or "")) if w]


def expected(pages, wiki, aliases):
    """(id, covered) by trying each name at each word of each page."""
    brands = {tuple(plain_words(n)) for n in [b for b, _, _ in wiki if b] + [x for pair in aliases for x in pair if x]} - {()}
    cars = [(b, tuple(w for w in plain_words(c) if w not in plain_words(b)), t) for b, c, t in wiki if b and c and t]
    out = {}
    for i, brand, tag, text in pages:
        ws, found = [w for s in sentences_of(text) for w in [*s, "\n"]], set()
        foreign = brands | {c for b, c, t in cars if c and b == brand and t != tag}
        for name in foreign:
            for at in range(len(ws)):
                if tuple(ws[at : at + len(name)]) == name:
                    found.update(range(at, at + len(name)))
        out[i] = sorted(found)
    return out


@pytest.mark.parametrize("most_chars", [tagger.AUTOMATON_CHARS, 0])
def test_all_names_are_found_as_by_brute_force(spark, most_chars):
    draw = random.Random(5)
    some = lambda k: " ".join(draw.choice("red blue Box rod gear VW golf plus a4 bmw".split()) for _ in range(k))
    wiki = [(draw.choice(["VW", "Audi", "Alfa Romeo", None]), some(draw.randint(1, 4)), f"page {n}") for n in range(25)]
    wiki += [("VW", None, "page x"), ("VW", "VW", "page y"), ("VW", "golf", "page 1"), ("VW", "golf", "page 2"), ("VW", "red golf plus", None)]
    aliases = [("VW", "Volkswagen"), ("BMW", "Bayerische Motoren"), ("Audi", None)]
    mark = lambda: draw.choice([" ", " ", " ", ", ", ". ", "! ", ".", "\n", " - "])
    pages = [(i, draw.choice(["VW", "Audi", "Alfa Romeo", "none", None]), draw.choice([f"page {draw.randint(0, 24)}", "page 1", None]), "".join(some(1) + mark() for _ in range(draw.randint(0, 60)))) for i in range(120)]
    pages += [(200, "VW", "page 1", None), (201, "VW", "page 1", ""), (202, "VW", "page 1", "Alfa Romeo. Alfa\nRomeo alfa, romeo"), (203, "VW", "page 1", " ..!\n"), (204, "VW", "page 3", pages[0][3])]
    pages += [(205, *pages[1][1:]), (206, "VW", "page 1", "golf " * 5000 + "red golf plus volkswagen")]
    rows, names = spark.createDataFrame(pages, PAGES), tagger.dictionary(spark.createDataFrame(wiki, WIKI), spark.createDataFrame(aliases, "brand string, alias string"))
    got = {r["id"]: list(r["covered"]) for r in tagger.tagged(rows, names, most_chars).collect()}
    want = expected(pages, wiki, aliases)
    assert got == want and sum(map(bool, want.values())) > 60 and got[202] == [0, 1, 6, 7]


@pytest.mark.parametrize("most_chars", [tagger.AUTOMATON_CHARS, 0])
def test_sentences_about_the_car(spark, most_chars):
    wiki = [("VW", "Golf", "VW Golf"), ("VW", "Golf Plus", "VW Golf Plus"), ("VW", "Polo", "VW Polo"), ("Audi", "Rain", "Audi Rain")]
    text = "The Golf is no Polo. It may rain! A VW type\nThe Golf Plus of Volkswagen: golf. In 1999 Polo; Polo nothing.\n\nPolo? VW."
    names = tagger.dictionary(spark.createDataFrame(wiki, WIKI), spark.createDataFrame([("VW", "Volkswagen")], "brand string, alias string"))
    rows = spark.createDataFrame([(1, "VW", "VW Golf", text), (2, None, None, "VW Golf. In 1999"), (3, "VW", "VW Polo", None)], PAGES)
    got = {r["id"]: [tuple(s) for s in r["sentences"]] for r in tagger.relevant_sentences(rows, names, most_chars).collect()}
    assert got[1] == [
        ("the golf is no polo", "the golf is no", True),
        ("it may rain", "it may rain", False),
        ("a vw type", "a type", True),
        ("the golf plus of volkswagen golf", "the golf of golf", True),
        ("in 1999 polo polo nothing", "in 1999 nothing", True),
        ("polo", "", False),
        ("vw", "", False),
    ]
    assert got[2] == [("vw golf", "golf", False), ("in 1999", "in 1999", True)] and got[3] == []


@pytest.mark.parametrize("most_chars", [tagger.AUTOMATON_CHARS, 0])
def test_empty_tables_and_columns_of_the_same_name(spark, most_chars):
    none, named = spark.createDataFrame([], WIKI), spark.createDataFrame([("VW", "Golf", "VW Golf")], WIKI)
    rows = spark.createDataFrame([("VW", "VW Polo", "A Golf.", "own", [9], "key")], "brand string, tag string, page_text string, words string, covered array<int>, phrase string")
    out = tagger.relevant_sentences(rows, tagger.dictionary(none), most_chars).first()
    assert [tuple(s) for s in out["sentences"]] == [("a golf", "a golf", False)] and out["phrase"] == "key"
    assert [tuple(s) for s in tagger.relevant_sentences(rows, tagger.dictionary(named), most_chars).first()["sentences"]] == [("a golf", "a", False)]
    assert tagger.relevant_sentences(rows.limit(0), tagger.dictionary(named), most_chars).count() == 0


def test_texts_stay_where_they_are(spark):
    names = tagger.dictionary(spark.createDataFrame([("VW", "Golf", "VW Golf")], WIKI))
    pages = sinks.kept(spark.createDataFrame([(1, "VW", "VW Polo", "A Golf.")], PAGES), "pages")
    plan = tagger.relevant_sentences(pages, names)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
