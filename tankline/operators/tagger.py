"""Names of brands and models in page texts, found by a dictionary tagger, and the sentences that are about a page's car."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.text import RELEVANT_WORDS, words
from ..sources.sinks import kept

#: Where a sentence ends: a mark before white space, or a line's end.
SENTENCE_END = r"[.!?][ \t\n\r\f]+|[\n\r]+"
#: Stands for the end of a sentence among a text's words; no name has it.
END = "\n"
#: Characters of all names, up to which one automaton has them all and goes to every task.
AUTOMATON_CHARS = 4 << 20
#: Parts that the occurrences of one name are dealt over where names are joined.
SALTS = 16
_automatons: dict[str, object] = {}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def text_words(page_text: Column) -> Column:
    """The words of a text in lower case, END behind each sentence; sentences without words are left out, and a null has none."""
    sentences = F.filter(F.transform(F.split(F.coalesce(page_text, F.lit("")), SENTENCE_END), words), lambda s: F.size(s) > 0)
    return F.flatten(F.transform(sentences, lambda s: F.concat(s, F.array(F.lit(END)))))


def dictionary(wiki: DataFrame, brands: DataFrame | None = None) -> DataFrame:
    """(phrase, brand, first_tag, last_tag): the words of the names that a text may have. Those of brands (brand, alias), and of the
    brands of wiki, have no brand here. Those of cars, without the words of their brand, stand once for each brand, with the first and
    the last page that has them, which is enough to tell whether they name another page than a given one. Nulls and names
    without words are left out."""
    own = F.filter(words(F.col("car_name")), lambda w: ~F.array_contains(words(F.col("brand_name")), w))
    cars = wiki.select(F.array_join(own, " ").alias("phrase"), F.col("brand_name").alias("brand"), F.col("wiki_name").alias("tag")).filter("brand is not null and tag is not null")
    cars = cars.groupBy("phrase", "brand").agg(F.min("tag").alias("first_tag"), F.max("tag").alias("last_tag"))
    names = wiki.select(F.col("brand_name").alias("name"))
    if brands is not None:
        names = names.unionByName(brands.select(F.col("alias").alias("name"))).unionByName(brands.select(F.col("brand").alias("name")))
    none = F.lit(None).cast("string")
    names = names.select(F.array_join(words(F.col("name")), " ").alias("phrase"), none.alias("brand"), none.alias("first_tag"), none.alias("last_tag")).distinct()
    return cars.unionByName(names).filter("phrase <> ''")


def tagged(pages: DataFrame, names: DataFrame, most_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """pages (brand, tag, page_text, and others) with words (see text_words) and covered: the places in words, from 0, of those that lie in
    a brand's name or in the name of another car of the page's brand (names as by dictionary). All occurrences count, those that
    overlap too, and upper and lower case are one. A page without tag is none of its brand's cars.

    Names of up to most_chars characters together become an Aho-Corasick automaton, which passes over each text once,
    however many names there are; texts stay where they are and nothing is shuffled. More names than that are joined with the
    runs of words of the lengths that names have, by equality, with each name's occurrences dealt over SALTS parts.
    """
    stored = kept(names, "names")
    size = stored.agg(F.sum(F.length("phrase") + F.coalesce(F.length(F.concat_ws("", "brand", "first_tag", "last_tag")), F.lit(0)))).first()[0] or 0
    worded = pages.withColumn("words", text_words(F.col("page_text")))
    return _by_automaton(worded, stored) if size <= most_chars else _by_join(worded, stored)


def _automaton(key: str, names: Broadcast):
    """The automaton of names (phrase, brand, first_tag, last_tag), built once a Python worker for each key."""
    if key not in _automatons:
        import ahocorasick

        found: dict[str, tuple[int, dict]] = {}
        for phrase, brand, first, last in names.value:
            found.setdefault(phrase, (phrase.count(" ") + 1, {}))[1][brand] = (first, last)
        automaton = ahocorasick.Automaton()
        for phrase, value in found.items():
            automaton.add_word(f" {phrase} ", value)
        automaton.make_automaton()
        _automatons.clear()
        _automatons[key] = automaton
    return _automatons[key]


def _places(automaton, text: str, brand: str | None, tag: str | None) -> list[int]:
    """The places of words in names of brands and of other cars of the brand; hits come in the order of their ends."""
    if not len(automaton):
        return []
    padded, at, word, out = f" {text} ", 0, -1, set()
    for end, (n, whose) in automaton.iter(padded):
        word, at = word + padded.count(" ", at, end), end
        if None in whose or (brand is not None and any(t != tag for t in whose.get(brand, ()))):
            out.update(range(word - n + 1, word + 1))
    return sorted(out)


def _by_automaton(pages: DataFrame, names: DataFrame) -> DataFrame:
    key, entries = uuid.uuid4().hex, pages.sparkSession.sparkContext.broadcast([tuple(r) for r in names.select("phrase", "brand", "first_tag", "last_tag").collect()])

    @F.arrow_udf(ArrayType(IntegerType()))
    def places(text: pa.Array, brand: pa.Array, tag: pa.Array) -> pa.Array:
        automaton = _automaton(key, entries)
        return pa.array([_places(automaton, *(c.as_py() for c in row)) for row in zip(text, brand, tag)], pa.list_(pa.int32()))

    return pages.withColumn("covered", places(F.array_join("words", " "), F.col("brand"), F.col("tag")))


def _by_join(pages: DataFrame, names: DataFrame) -> DataFrame:
    keyed = pages.withColumn("text_key", F.md5(F.to_json(F.struct("brand", "tag", "page_text"))))
    texts = kept(keyed.select("text_key", "brand", "tag", "words").dropDuplicates(["text_key"]), "texts")
    length = F.size(F.split("phrase", " "))
    lengths = [r[0] for r in names.select(length).distinct().collect()]

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(0), F.size("words") - n)
        return F.when(F.size("words") >= n, F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice("words", i + 1, F.lit(n)), " ").alias("phrase"))))

    none = F.array().cast("array<int>")
    many = F.array(*map(runs, lengths)) if lengths else F.array().cast("array<array<struct<at:int,n:int,phrase:string>>>")
    each = texts.select("text_key", "brand", "tag", F.explode(many).alias("runs")).select("text_key", "brand", "tag", F.inline("runs"))
    each = each.withColumn("salt", F.pmod(F.xxhash64("text_key", "at"), F.lit(SALTS)))
    salted = names.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    of_brands = each.join(salted.filter("brand is null").select("phrase", "salt"), ["phrase", "salt"]).select("text_key", "at", "n")
    other = ~(F.col("first_tag").eqNullSafe(F.col("tag")) & F.col("last_tag").eqNullSafe(F.col("tag")))
    of_cars = each.join(salted.filter("brand is not null"), ["phrase", "brand", "salt"]).filter(other).select("text_key", "at", "n")
    places = of_brands.unionByName(of_cars).select("text_key", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("place"))
    covered = places.groupBy("text_key").agg(F.array_sort(F.collect_set("place")).alias("covered"))
    return keyed.join(covered, "text_key", "left").withColumn("covered", F.coalesce("covered", none)).drop("text_key")


def _without(all_words: Column, places: Column) -> Column:
    """all_words without those at places (ascending, from 0): the runs between places, one after the other."""
    def runs(cuts: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), lambda k: F.slice(all_words, cuts[k] + 2, cuts[k + 1] - cuts[k] - 1)))

    return _let(F.concat(F.array(F.lit(-1)), places, F.array(F.size(all_words))), runs)


def relevant_sentences(pages: DataFrame, names: DataFrame, most_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """pages (brand, tag, page_text, and others) with sentences, an array of (sentence, left, relevant): each sentence's words, what is
    left of them without names of brands and of other cars of the brand (see tagged), and whether it is about the page's car: one
    of the words left is in the page's name or is a telling word, or the sentence has a digit. Words of the page's own
    name, without its brand, always stay. A page without text has no sentences. Columns words and covered of pages give way."""
    none = F.array().cast("array<string>")
    own = F.coalesce(F.array_except(words(F.col("tag")), F.coalesce(words(F.col("brand")), none)), none)
    asked = tagged(pages.drop("words", "covered"), names, most_chars)

    def told(v: Column) -> Column:
        places = F.filter(v["covered"], lambda i: ~F.array_contains(v["own"], F.get(v["words"], i)))
        split = lambda ws: F.slice(F.split(F.array_join(ws, " "), END), F.lit(1), F.size(F.filter(v["words"], lambda w: w == END)))
        telling = F.array_union(v["own"], F.array(*[F.lit(w) for w in RELEVANT_WORDS]))
        about = lambda s, left: F.arrays_overlap(F.split(left, " "), telling) | s.rlike(r"\d")
        return F.zip_with(split(v["words"]), split(_without(v["words"], places)), lambda s, left: F.struct(F.trim(s).alias("sentence"), F.trim(left).alias("left"), about(s, left).alias("relevant")))

    value = F.struct(F.col("words"), F.col("covered"), own.alias("own"))
    return asked.withColumn("sentences", _let(value, told)).drop("words", "covered")
