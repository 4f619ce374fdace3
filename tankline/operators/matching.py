"""Entity matching: from a car's name to the pages it is about, by curated lists, text candidates and similarity."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MOST_WORDS, before_single_comma, key_of, powerset, words
from ..sources.sinks import kept
from .containment import contained, name_words
from .similarity import AS_OF, judgement, with_similarity
from .tagger import dictionary, relevant_sentences

# Required scores, the band below them, and lower floors of some brands.
MIN_PROBABILITY, BAND, DEFAULT_SCORE, REGISTER_SCORE, SENSOR_SCORE = 0.25, 0.06, 0.99, 0.96, 0.99998
BRAND_FLOORS = {"Daihatsu": 0.4, "Audi": 0.85, "BMW": 0.97}
#: Parts that the cars with one word are dealt over.
SALTS = 8
#: Rows up to which a table of names is broadcast.
FEW = 200_000
#: What is added to the counts of patterns with and without a word.
SMOOTHING = 0.1


class Matches(NamedTuple):
    """Cars and their pages, without a row for each car and page: what finds pages is a name, and many cars have one name, and many
    pages one key. cars (car_id, name_id): the names of each car. names (name_id, brand, name, ..., found): all names, with
    what each finds, a sorted array of (stage, key). pages (key, hash_id). Stage 0, the curated list, stands alone; of the
    other stages all count, each page with its first, or with first only a car's first one; and then none beyond most."""

    cars: DataFrame
    names: DataFrame
    pages: DataFrame
    first: bool = False
    most: int | None = None

    def picked(self, found: Column) -> Column:
        """What counts of the (stage, key) of all of a car's names."""
        least = F.array_min(F.transform(found, lambda f: f["stage"]))
        out = F.filter(found, lambda f: (f["stage"] == least) | (F.lit(not self.first) & (least > 0)))
        return out if self.most is None else F.filter(out, lambda f: f["stage"] <= self.most)

    def by_names(self) -> tuple[DataFrame, DataFrame]:
        """(one, several): cars (car_id, name_id) that have one name, nearly all, and for the others (car_id, brand, name, found), a row
        for each name, with what counts of all names together. Cars are shuffled once."""
        dealt = self.cars.select(F.struct("car_id").alias("car"), "name_id").repartition("car")  # a struct isn't null, so each use has the same plan
        ends = dealt.groupBy("car").agg(F.min("name_id").alias("name_id"), F.max("name_id").alias("last"))
        one = ends.filter("name_id = last").select("car.car_id", "name_id")
        many = ends.filter("name_id <> last").select("car").hint("shuffle_hash")
        named = dealt.join(many, "car").distinct().join(self.names, "name_id").select("car.car_id", "name_id", "brand", "name", "found")
        own = named.groupBy("car_id").agg(F.collect_set(F.struct("brand", "name")).alias("own"), F.flatten(F.collect_set("found")).alias("found"))
        return one, own.select("car_id", F.inline("own"), self.picked(F.array_sort(F.array_distinct("found"))).alias("found"))

    def of(self, rows: DataFrame, *keys: str) -> DataFrame:
        """(keys, stage, hash_id): the pages that rows (keys, found) have, each once with its first stage."""
        return rows.select(*keys, F.inline("found")).join(self.pages, "key").groupBy(*keys, "hash_id").agg(F.min("stage").alias("stage"))

    def each(self) -> DataFrame:
        """(car_id, stage, hash_id): a row for each car and page, as many as there are."""
        one, several = self.by_names()
        alone = one.join(few(self.names.select("name_id", self.picked(F.col("found")).alias("found"))), "name_id").select("car_id", "found")
        return self.of(alone.unionByName(several.select("car_id", "found").distinct()), "car_id").select("car_id", "stage", "hash_id")

    def per_car(self, *aggregates: Column) -> DataFrame:
        """(car_id, stage, aggregates): aggregates over the pages (hash_id) of each car and stage, worked out once for all names that
        find the same. Only cars with several names have theirs worked out alone."""
        one, several = self.by_names()
        found = self.names.select("name_id", self.picked(F.col("found")).alias("found")).filter(F.size("found") > 0)
        shared = self.of(found.select("found").distinct().withColumn("key_found", F.col("found")), "key_found").groupBy("key_found", "stage").agg(*aggregates)
        by_name = kept(found.join(shared, F.col("found") == F.col("key_found")).drop("found", "key_found"), "pages-of-names")
        own = self.of(several.select("car_id", "found").distinct(), "car_id").groupBy("car_id", "stage").agg(*aggregates)
        return one.join(few(by_name), "name_id").drop("name_id").unionByName(own)


def few(df: DataFrame) -> DataFrame:
    """A stored table, broadcast where it has at most FEW rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def by_name(cars: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(cars, names): cars (car_id, name_id) and their different names (name_id, columns), numbered and stored. Nulls are values like
    any other."""
    names = kept(cars.select(*columns).distinct().withColumn("name_id", F.monotonically_increasing_id()), "car-names")
    own = few(names.select("name_id", *[F.col(c).alias(f"own_{c}") for c in columns]))
    same = [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in columns]
    return cars.select("car_id", *columns).join(own, same).select("car_id", F.coalesce("name_id", F.lit(-1)).alias("name_id")), names  # never null


def _tag_key(tag: Column) -> Column:
    return F.struct(F.lit(0).alias("kind"), F.lit("").alias("brand"), tag.alias("name")).alias("key")


def _form_key() -> Column:
    return F.struct(F.lit(1).alias("kind"), F.col("brand"), F.col("form").alias("name")).alias("key")


def _tag_pages(wiki: DataFrame) -> DataFrame:
    return wiki.filter("wiki_name is not null").select(_tag_key(F.col("wiki_name")), "hash_id")


def _with_found(names: DataFrame, *found: DataFrame) -> DataFrame:
    """names with all that they find, of found (name_id, stage, key)."""
    rows = reduce(DataFrame.unionByName, found)
    each = rows.groupBy("name_id").agg(F.array_sort(F.collect_set(F.struct("stage", "key"))).alias("found"))
    nothing = F.array().cast(each.schema["found"].dataType)
    return kept(names.join(each, "name_id", "left").withColumn("found", F.coalesce("found", nothing)), "found-names")


def _listed(names: DataFrame, curated: DataFrame) -> DataFrame:
    """(name_id, stage, key): the page names that a curated list has for names, as stage 0."""
    rows = names.select("name_id", "brand", F.explode(F.array(F.lower("name"), F.concat(F.lower("name"), F.coalesce(F.col("year").cast("string"), F.lit(""))))).alias("entry"))
    named = rows.join(curated.filter("wiki_name is not null").select("brand", F.lower("entry").alias("entry"), "wiki_name").distinct(), ["brand", "entry"])
    return named.select("name_id", F.lit(0).alias("stage"), _tag_key(F.col("wiki_name")))


def curated_names(cars: DataFrame, curated: DataFrame, wiki: DataFrame) -> Matches:
    """Cars (car_id, brand, name, year) whose name, or name and year end to end, a curated list (brand, entry, wiki_name) has, with
    the pages of that name. A brand that isn't in the list has no match."""
    own, names = by_name(cars, "brand", "name", "year")
    return Matches(own, _with_found(names, _listed(names, curated)), _tag_pages(wiki))


def curated_matches(cars: DataFrame, curated: DataFrame, wiki: DataFrame) -> DataFrame:
    """(car_id, hash_id): curated_names with a row for each car and page."""
    return curated_names(cars, curated, wiki).each().select("car_id", "hash_id")


def candidate_texts(cars: DataFrame, aliases: DataFrame) -> DataFrame:
    """(car_id, brand, text): the brand or an alias before each choice of the name's words (its first MOST_WORDS), in each case;
    years are taken out. What these find by name contained_pages finds for names of any length."""
    named = F.regexp_replace(F.col("name"), r"\b(19[89]\d|20\d\d)\b", " ")
    pieces = F.slice(F.array_remove(F.split(named, r"\s+"), ""), 1, MOST_WORDS)
    rows = cars.select("car_id", "brand", F.explode(powerset(pieces)).alias("part"))
    names = aliases.select("brand", "alias").unionByName(cars.select("brand", F.col("brand").alias("alias"))).distinct()
    return rows.join(names, "brand").select("car_id", "brand", F.concat_ws(" ", "alias", "part").alias("text")).distinct()


def contained_pages(cars: DataFrame, wiki: DataFrame) -> DataFrame:
    """(car_id, brand, tag): the pages of a car's brand whose car's name is a choice of the words of the car's name, in order and in any
    case, years taken out: what asking about each of candidate_texts would find by name, for names of any length."""
    named = F.regexp_replace(F.col("name"), r"\b(19[89]\d|20\d\d)\b", " ")
    wholes = cars.select(F.col("brand").alias("group"), F.col("car_id").alias("whole"), name_words(named).alias("words"))
    parts = wiki.select(F.col("brand_name").alias("group"), F.col("wiki_name").alias("part"), name_words(F.col("car_name")).alias("words")).distinct()
    return contained(parts, wholes).select(F.col("whole").alias("car_id"), F.col("group").alias("brand"), F.col("part").alias("tag")).distinct()


def judged_patterns(patterns: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(brand, tag, pattern, polarity): the patterns (brand, tag, pattern) that are choices of the words of a reviewed name (brand,
    name, tag, right) of the same tag, the brand's words left out: the rows of verdict_patterns that such a pattern meets, in any
    case and for names of any length."""
    bare = F.array_except(name_words(F.col("name")), name_words(F.col("brand")))
    key = F.to_json(F.struct("brand", "tag"))
    wholes = verdicts.select(key.alias("group"), F.when(F.col("right"), "positive").otherwise("negative").alias("whole"), bare.alias("words")).distinct()
    parts = patterns.select(key.alias("group"), F.struct("brand", "tag", "pattern").alias("part"), name_words(F.col("pattern")).alias("words")).distinct()
    return contained(parts, wholes).select("part.*", F.col("whole").alias("polarity")).distinct()


def training_patterns(wiki: DataFrame, labelled: DataFrame, pages: DataFrame | None = None, brands: DataFrame | None = None) -> DataFrame:
    """(brand, tag, pattern): for each page its name, its car's name and casings, the labelled positive patterns, and what the
    relevant sentences of its text (brand, tag, page_text) have beside names of brands (of wiki, and brands (brand, alias) if given)
    and of other cars (see tagger.relevant_sentences), without labelled negatives."""
    forms = F.array_distinct(F.array("wiki_name", "car_name", F.lower("car_name"), F.upper("car_name"), F.initcap("car_name")))
    own = wiki.select(F.col("brand_name").alias("brand"), F.col("wiki_name").alias("tag"), F.explode(forms).alias("pattern"))
    out = own.unionByName(labelled.filter("polarity = 'positive'").select("brand", "tag", "pattern"))
    if pages is not None:
        told = relevant_sentences(pages.select("brand", "tag", "page_text"), dictionary(wiki, brands))
        sentences = told.select("brand", "tag", F.inline("sentences")).filter("relevant and left <> ''")
        out = out.unionByName(sentences.select("brand", "tag", F.col("left").alias("pattern")))
    negative = labelled.filter("polarity = 'negative'").select("brand", "tag", "pattern")
    return out.distinct().join(negative, ["brand", "tag", "pattern"], "left_anti")


def merged_patterns(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Labelled patterns (brand, tag, polarity, pattern) of both, each once."""
    return stored.unionByName(new).distinct()


def word_features(patterns: DataFrame, column: str = "pattern") -> DataFrame:
    """patterns with their words, each once, without those of the brand: a brand's model has nothing to learn from them."""
    plain = lambda c: F.coalesce(words(F.col(c)), F.array().cast("array<string>"))
    return patterns.withColumn("words", F.array_except(plain(column), plain("brand")))


class Classifier(NamedTuple):
    """tags (brand, tag, base, step): a tag's logarithm for a text without words, and what a known word that it lacks adds.
    gains (brand, word, tag, gain): what a word that it has adds beyond that."""

    tags: DataFrame
    gains: DataFrame


def train(patterns: DataFrame) -> Classifier:
    """A classifier for each brand from the words of patterns (brand, tag, pattern) to the tag: Bernoulli naive Bayes, with
    counts smoothed by SMOOTHING. All words and tags count, and all stays in tables. Rows without a brand have no model."""
    rows = word_features(patterns).filter("brand is not null and tag is not null")
    sizes = rows.groupBy("brand", "tag").agg(F.count("*").alias("n"))
    seen = rows.select("brand", "tag", F.explode("words").alias("word")).groupBy("brand", "tag", "word").agg(F.count("*").alias("c"))
    brand_sizes = sizes.groupBy("brand").agg(F.sum("n").alias("all_n")).join(seen.groupBy("brand").agg(F.countDistinct("word").alias("v")), "brand", "left")
    p, none = (F.col("c") + SMOOTHING) / (F.col("n") + 2 * SMOOTHING), F.lit(SMOOTHING) / (F.col("n") + 2 * SMOOTHING)
    step = F.log(none / (1 - none))
    each = seen.join(sizes, ["brand", "tag"]).select("brand", "word", "tag", (F.log(p / (1 - p)) - step).alias("gain"), F.log(1 - p).alias("absent"))
    absent = each.groupBy("brand", "tag").agg(F.sum("absent").alias("absent"), F.count("*").alias("own"))
    lacking = F.coalesce("absent", F.lit(0.0)) + (F.coalesce("v", F.lit(0)) - F.coalesce("own", F.lit(0))) * F.log(1 - none)
    tags = sizes.join(absent, ["brand", "tag"], "left").join(brand_sizes, "brand").select("brand", "tag", (F.log(F.col("n") / F.col("all_n")) + lacking).alias("base"), step.alias("step"))
    return Classifier(tags, each.drop("absent"))


def scores(model: Classifier, texts: DataFrame, keep: int = 10) -> DataFrame:
    """(car_id, brand, text, tag, score): the tags of its brand above the least probability for each text, at most keep, best
    first. Texts meet tags by brand and word; the tags that share no word are summed once for each brand and number of
    known words, and as at most three tags can pass 0.25, the three likeliest of them are all that is looked at."""
    own = word_features(texts.select("brand", "text").distinct(), "text")
    known = model.gains.select("brand", "word").distinct()
    asked = own.select("brand", "text", F.explode("words").alias("word")).join(known, ["brand", "word"])
    counted = own.select("brand", "text").join(asked.groupBy("brand", "text").agg(F.count("*").alias("k")), ["brand", "text"], "left").fillna(0, ["k"])
    apart = counted.select("brand", "k").distinct().join(model.tags, "brand").select("brand", "k", "tag", (F.col("base") + F.col("k") * F.col("step")).alias("least"))
    top = apart.groupBy("brand", "k").agg(F.max("least").alias("most"))
    total = apart.join(top, ["brand", "k"]).groupBy("brand", "k", "most").agg(F.sum(F.exp(F.col("least") - F.col("most"))).alias("total"))
    likely = apart.withColumn("rank", F.row_number().over(Window.partitionBy("brand", "k").orderBy(F.desc("least"), "tag"))).filter("rank <= 3").select("brand", "k", "tag")
    salted = asked.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)))
    gains = model.gains.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    shared = salted.join(gains, ["brand", "word", "salt"]).select("brand", "text", "tag", "gain")
    also = counted.join(likely, ["brand", "k"]).select("brand", "text", "tag", F.lit(0.0).alias("gain"))
    met = shared.unionByName(also).groupBy("brand", "text", "tag").agg(F.sum("gain").alias("gain"))
    j = met.join(counted, ["brand", "text"]).join(apart, ["brand", "k", "tag"]).join(total, ["brand", "k"]).withColumn("logit", F.col("least") + F.col("gain"))
    text = Window.partitionBy("brand", "text")
    j = j.withColumn("high", F.greatest("most", F.max("logit").over(text)))
    mass = F.sum(F.exp(F.col("logit") - F.col("high")) - F.exp(F.col("least") - F.col("high"))).over(text) + F.col("total") * F.exp(F.col("most") - F.col("high"))
    each = j.withColumn("score", F.exp(F.col("logit") - F.col("high")) / mass).filter(F.col("score") > MIN_PROBABILITY)
    best = each.withColumn("rank", F.row_number().over(text.orderBy(F.desc("score"), "tag"))).filter(F.col("rank") <= keep)
    return texts.select("car_id", "brand", "text").join(best.select("brand", "text", "tag", "score"), ["brand", "text"]).select("car_id", "brand", "text", "tag", "score")


def needs_training(patterns: DataFrame, known_tags: int) -> bool:
    """Whether the number of tags differs from that of the stored model."""
    return patterns.select("tag").distinct().count() != known_tags


def accepted(scored: DataFrame, wiki: DataFrame, aliases: DataFrame, required: float = DEFAULT_SCORE, complex_rules: bool = True, as_of: int = AS_OF) -> DataFrame:
    """(car_id, hash_id, rule): accepted_tags with their pages."""
    pages = wiki.select(F.col("wiki_name").alias("tag"), "hash_id")
    return accepted_tags(scored, aliases, required, complex_rules, as_of).join(pages, "tag").groupBy("car_id", "hash_id").agg(F.min("rule").alias("rule"))


def accepted_tags(scored: DataFrame, aliases: DataFrame, required: float = DEFAULT_SCORE, complex_rules: bool = True, as_of: int = AS_OF) -> DataFrame:
    """(car_id, tag, rule): scored candidates (car_id, brand, name, year, tag, score) that a rule accepts; the first rule
    that holds is told. 1: the score is reached. Then, with complex rules, 2: the score is in the band below and all words
    of the page's name are in brand and name; outside the band 3: the names are alike in one of three forms, 4: the
    brand's own floor is reached; and in any case 5: they are alike with an alias in front.

    Rules are judged on distinct names, stored once, not on cars: those that built-in functions can tell first, then similarity
    (see similarity.with_similarity), for names that are still open, with all forms of a rule in one comparison, and aliases only
    for names that no rule before has accepted. Cars are joined at the end.
    """
    columns = ["brand", "name", "tag", "score"]
    first = F.when(F.col("score") >= required, 1)
    in_band = F.col("score") >= required - BAND
    full = F.concat_ws(" ", "brand", "name")
    if complex_rules:
        first = first.when(in_band & (F.size(F.array_except(words(F.col("tag")), words(full))) == 0), 2)
    judged = kept(scored.select(*columns).distinct().select(F.xxhash64(*columns).alias("key"), *columns, first.alias("rule")), "names")
    found = judged.filter("rule is not null")
    if complex_rules:
        left = judged.filter("rule is null").drop("rule")
        bare = F.replace(F.col("tag"), F.concat(F.col("brand"), F.lit(" ")), F.lit(""))
        own_name = F.replace(F.col("name"), F.concat(F.col("brand"), F.lit(" ")), F.lit(""))
        forms = ((full, F.col("tag")), (own_name, bare), (F.concat_ws(" ", "brand", own_name), F.col("tag")))
        floor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in BRAND_FLOORS.items() for x in p]), F.col("brand")), F.lit(2.0))
        below = with_similarity(left.filter(~in_band), *[judgement(a, b, as_of=as_of) for a, b in forms])
        below = below.withColumn("rule", F.when(F.col("alike"), 3).when(F.col("score") >= floor, 4)).drop("alike")
        below = kept(left.filter(in_band).withColumn("rule", F.lit(None).cast("int")).unionByName(below), "judged-names")
        aliased = below.filter("rule is null").drop("rule").join(aliases.select("brand", "alias"), "brand")
        without = lambda c: F.replace(c, F.col("alias"), F.lit(""))
        forms = ((F.concat_ws(" ", "alias", "brand", "name"), F.col("tag")), (F.concat_ws(" ", F.col("alias"), without(F.col("name"))), without(F.col("tag"))))
        named = with_similarity(aliased, *[judgement(a, b, as_of=as_of) for a, b in forms]).filter("alike")
        found = found.unionByName(below.filter("rule is not null")).unionByName(named.select("key", *columns, F.lit(5).alias("rule")))
    least = found.groupBy("key", *columns).agg(F.min("rule").alias("rule"))
    asked = scored.select("car_id", *columns).withColumn("key", F.xxhash64(*columns))
    return asked.join(least, ["key", *columns]).groupBy("car_id", "tag").agg(F.min("rule").alias("rule"))


def name_matches(cars: DataFrame, wiki: DataFrame) -> DataFrame:
    """(car_id, tag, score): all cars and page names of a brand that share a word beside it, with the share of common words
    (Dice). Pairs come from an equi-join on brand and each word; a pair that shares several is kept at the first of them.
    Cars are dealt over SALTS parts of each word, as a common word has many. Pages with one name are one."""
    own = cars.select("car_id", "brand", "name").distinct().select("car_id", "brand", F.array_distinct(words(F.col("name"))).alias("w"))
    page = wiki.select(F.col("brand_name").alias("brand"), F.col("wiki_name").alias("tag"), F.array_distinct(words(F.col("car_name"))).alias("pw")).distinct()
    asked = own.withColumn("word", F.explode("w")).withColumn("salt", F.pmod(F.xxhash64("car_id", "w"), F.lit(SALTS)))
    spread = page.withColumn("word", F.explode("pw")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    both = F.array_intersect("w", "pw")
    pairs = asked.join(spread, ["brand", "word", "salt"]).filter(F.col("word") == F.get(both, F.lit(0)))
    return pairs.select("car_id", "tag", (2 * F.size(both) / (F.size("w") + F.size("pw"))).alias("score")).distinct()


def register_forms(cars: DataFrame) -> DataFrame:
    """(car_id, brand, stage, form): what a register car is looked up by, in order: 1 name (before a single comma), 2 with
    year, 3 with description, 4 with both, and from 5 on the name with its last words dropped one by one."""
    name = before_single_comma(F.col("name"))
    parts = F.array_remove(F.split(name, r"\s+"), "")
    dropped = F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda k: F.struct((4 + F.size(parts) - k).alias("stage"), F.array_join(F.slice(parts, F.lit(1), k), " ").alias("form")))
    fixed = [(1, name), (2, F.concat_ws(" ", name, F.col("year").cast("string"))), (3, F.concat_ws(" ", name, "description")), (4, F.concat_ws(" ", name, "description", F.col("year").cast("string")))]
    first = F.array(*[F.struct(F.lit(s).alias("stage"), c.alias("form")) for s, c in fixed])
    return cars.select("car_id", "brand", "year", F.inline(F.when(F.size(parts) > 1, F.concat(first, dropped)).otherwise(first)))


def _by_form(forms: DataFrame, names: DataFrame, wiki: DataFrame, curated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names with what they find, pages): curated matches as stage 0, and the forms (name_id, brand, stage, form) of names that
    are a page's name or its car's name. Pages are joined by nobody here, so pages that share a name don't multiply anything."""
    own = F.explode(F.array_distinct(F.array(F.lower("wiki_name"), F.lower("car_name")))).alias("form")
    pages = wiki.select(F.col("brand_name").alias("brand"), own, "hash_id").filter("brand is not null and form is not null")
    known = forms.withColumn("form", F.lower("form")).join(pages.select("brand", "form").distinct(), ["brand", "form"], "left_semi")
    found = _with_found(names, _listed(names, curated), known.select("name_id", "stage", _form_key()))
    return found, pages.select(_form_key(), "hash_id").unionByName(_tag_pages(wiki))


def register_names(cars: DataFrame, wiki: DataFrame, curated: DataFrame) -> Matches:
    """Register cars (car_id, brand, name, year, description) by curated list (stage 0), else by the first of their forms that is a
    page's name or its car's name, ignoring case. No classifier is asked (see register_names_scored): a car whose forms are all
    no page's name is not matched. Forms are made and met once for each different name."""
    own, names = by_name(cars, "brand", "name", "year", "description")
    found, pages = _by_form(_of_names(register_forms, names), names, wiki, curated)
    return Matches(own, found, pages, first=True)


def match_register(cars: DataFrame, wiki: DataFrame, curated: DataFrame) -> DataFrame:
    """(car_id, stage, hash_id): register_names with a row for each car and page."""
    return register_names(cars, wiki, curated).each()


def _of_names(forms: Callable[[DataFrame], DataFrame], names: DataFrame) -> DataFrame:
    """The forms of names, by name_id."""
    return forms(names.withColumnRenamed("name_id", "car_id")).withColumnRenamed("car_id", "name_id")


def sensor_forms(cars: DataFrame) -> DataFrame:
    """(car_id, brand, stage, form): what a sensor is looked up by: name (1), name and year (2), brand and name (3), or brand, name
    and year (4)."""
    y = F.col("year").cast("string")
    named = [F.col("name"), F.concat_ws(" ", "name", y), F.concat_ws(" ", "brand", "name"), F.concat_ws(" ", "brand", "name", y)]
    return cars.select("car_id", "brand", F.inline(F.array(*[F.struct(F.lit(i).alias("stage"), c.alias("form")) for i, c in enumerate(named, 1)])))


def sensor_names(cars: DataFrame, wiki: DataFrame, curated: DataFrame) -> Matches:
    """Sensors (car_id, brand, name, year) by curated list (0), else all pages by one of sensor_forms, each page with its first
    stage. No classifier is asked: only names that are equal but for case match."""
    own, names = by_name(cars, "brand", "name", "year")
    found, pages = _by_form(_of_names(sensor_forms, names), names, wiki, curated)
    return Matches(own, found, pages)


def match_sensors(cars: DataFrame, wiki: DataFrame, curated: DataFrame) -> DataFrame:
    """(car_id, stage, hash_id): sensor_names with a row for each car and page."""
    return sensor_names(cars, wiki, curated).each()


def _asked(forms: DataFrame, ask: Callable[[DataFrame], DataFrame], aliases: DataFrame, required: dict[int, tuple[float, bool]]) -> DataFrame:
    """(brand, group, form, tag): the page names that the classifier finds for each distinct form, and that the rules accept by
    what the form's group requires, (score, complex rules). Forms are scored once for all groups."""
    texts = kept(forms.select("brand", F.col("form").alias("text")).distinct().withColumn("car_id", key_of(F.col("brand"), F.col("text"))), "forms")
    scored = kept(ask(texts).withColumnRenamed("text", "name"), "scored-forms")
    groups = forms.select("brand", "form", "group").distinct()
    out = None
    for group, (score, complex_rules) in required.items():
        own = groups.filter(F.col("group") == group).select(key_of(F.col("brand"), F.col("form")).alias("car_id"))
        hits = accepted_tags(scored.join(own, "car_id", "left_semi"), aliases, score, complex_rules).select("car_id", "tag", F.lit(group).alias("group"))
        out = hits if out is None else out.unionByName(hits)
    return texts.join(out, "car_id").select("brand", "group", F.col("text").alias("form"), "tag").distinct()


def _by_classifier(forms: DataFrame, names: DataFrame, curated: DataFrame, hits: DataFrame) -> DataFrame:
    """names with what they find: curated matches as stage 0, and the hits (brand, group, form, tag) of their forms (name_id, brand,
    group, stage, form)."""
    found = forms.join(hits, ["brand", "group", "form"]).filter("tag is not null").select("name_id", "stage", _tag_key(F.col("tag")))
    return _with_found(names, _listed(names, curated), found)


def register_names_scored(cars: DataFrame, wiki: DataFrame, curated: DataFrame, ask: Callable[[DataFrame], DataFrame], aliases: DataFrame, required: float = REGISTER_SCORE, complex_rules: bool = True) -> Matches:
    """Register cars (car_id, brand, name, year, description) by curated list (stage 0), else by the first of their forms (see
    register_forms) for which the classifier has a page that the rules accept: name, with year, with description and with both
    must reach required; names with their last words dropped DEFAULT_SCORE, without complex rules.

    ask gives the classifier's (car_id, brand, text, tag, score) of texts (car_id, brand, text): scores of this module, or that of
    network, with a model. It and the rules see each distinct form once, whatever the number of cars that have it. As a model knows
    words, whatever their case or order, and not the brand's, the combinations of brand and name in other cases that one
    might also ask about have the same scores.
    """
    own, names = by_name(cars, "brand", "name", "year", "description")
    forms = _of_names(register_forms, names).select("name_id", "brand", "stage", "form").withColumn("group", (F.col("stage") > 4).cast("int"))
    hits = _asked(forms, ask, aliases, {0: (required, complex_rules), 1: (DEFAULT_SCORE, False)})
    return Matches(own, _by_classifier(forms, names, curated, hits), _tag_pages(wiki), first=True)


def match_register_scored(*args, **options) -> DataFrame:
    """(car_id, stage, hash_id): register_names_scored with a row for each car and page."""
    return register_names_scored(*args, **options).each()


def sensor_names_scored(cars: DataFrame, wiki: DataFrame, curated: DataFrame, ask: Callable[[DataFrame], DataFrame], aliases: DataFrame, required: float = SENSOR_SCORE, complex_rules: bool = True, less: float = 0.03) -> Matches:
    """Sensors (car_id, brand, name, year) by curated list (0), else all pages that the classifier has and the rules accept for one
    of sensor_forms, all but the name alone at less below required."""
    own, names = by_name(cars, "brand", "name", "year")
    forms = _of_names(sensor_forms, names).withColumn("group", (F.col("stage") > 1).cast("int"))
    hits = _asked(forms, ask, aliases, {0: (required, complex_rules), 1: (required - less, complex_rules)})
    return Matches(own, _by_classifier(forms, names, curated, hits), _tag_pages(wiki))


def match_sensors_scored(*args, **options) -> DataFrame:
    """(car_id, stage, hash_id): sensor_names_scored with a row for each car and page."""
    return sensor_names_scored(*args, **options).each()


def bridge(matches: DataFrame) -> DataFrame:
    """(object_hash, car_id, hash_id): the rows that link cars to pages, with their key."""
    return matches.select("car_id", "hash_id").distinct().withColumn("object_hash", key_of(F.col("car_id"), F.col("hash_id")))


def review_queue(cars: DataFrame, matches: DataFrame) -> DataFrame:
    """One row for each brand and car name, of all sources: whether any of its cars is matched, and to which pages."""
    j = cars.join(matches.select("car_id", "hash_id"), "car_id", "left")
    return j.groupBy("brand", "name").agg(F.countDistinct("car_id").alias("cars"), (F.count("hash_id") > 0).alias("matched"), F.array_sort(F.collect_set("hash_id")).alias("pages"))


def names_queue(matches: Matches) -> DataFrame:
    """review_queue of all cars of matches and their pages. Cars are counted by name, and the pages of a name are united once for all
    names that find the same."""
    one, several = matches.by_names()
    names = matches.names.select("name_id", "brand", "name", matches.picked(F.col("found")).alias("found"))
    counted = names.join(one.groupBy("name_id").agg(F.count("car_id").alias("n")), "name_id").select("brand", "name", "n", "found")
    rows = kept(counted.unionByName(several.groupBy("brand", "name", "found").agg(F.count("car_id").alias("n"))), "counted-names")
    cars = rows.groupBy("brand", "name").agg(F.sum("n").alias("cars"))
    met = matches.of(rows.filter("n > 0").select("brand", "name", "found").distinct(), "brand", "name").groupBy("brand", "name").agg(F.array_sort(F.collect_set("hash_id")).alias("pages"))
    both = cars.join(met.withColumnsRenamed({"brand": "own_brand", "name": "own_name"}), F.col("brand").eqNullSafe(F.col("own_brand")) & F.col("name").eqNullSafe(F.col("own_name")), "left")
    pages = F.coalesce("pages", F.array().cast("array<string>"))
    return both.select("brand", "name", "cars", (F.size(pages) > 0).alias("matched"), pages.alias("pages"))


def verdict_patterns(verdicts: DataFrame) -> DataFrame:
    """Reviewed (brand, name, tag, right) as labelled patterns: each choice of the name's first MOST_WORDS words, without the
    brand's. judged_patterns tells which of given patterns are choices of names of any length."""
    own = F.slice(F.array_except(F.array_remove(F.split(F.col("name"), r"\s+"), ""), F.split(F.col("brand"), r"\s+")), 1, MOST_WORDS)
    return verdicts.select("brand", "tag", F.when(F.col("right"), "positive").otherwise("negative").alias("polarity"), F.explode(powerset(own)).alias("pattern"))


def accuracy(queue: DataFrame) -> DataFrame:
    return queue.agg(F.try_divide(F.count_if("matched"), F.count("*")).alias("matched_ratio"))
