"""String functions as Column expressions: labels, names, years, numbers and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of fuels and what they stand for.
FUEL_LABELS = {
    "diesel": "diesel",
    "diesel_electric": "diesel_electric", "diesel electric": "diesel_electric", "electricity / diesel": "diesel_electric",
    "gasoline": "gasoline", "petrol": "gasoline", "gas": "gasoline",
    "gasoline_electric": "gasoline_electric", "electricity / petrol": "gasoline_electric", "petrol electric": "gasoline_electric", "petrol hybrid": "gasoline_electric",
    "electric": "electric", "electricity": "electric",
}
#: Words that make a sentence worth keeping.
RELEVANT_WORDS = ("model", "type", "typ", "generation")
FIRST_YEAR = 1980
#: A powerset of more words than this isn't made: it doubles with each word.
MOST_WORDS = 12


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def folded(c: Column) -> Column:
    """Stripped and in lower case, for comparisons that ignore case."""
    return F.lower(stripped(c))


def fuel_type(raw: Column) -> Column:
    """The canonical fuel of a label, whatever its case; an unknown label stays as it is."""
    labels = F.create_map(*[F.lit(x) for pair in FUEL_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, folded(raw)), raw)


def year_in_name(name: Column, as_of: int | Column) -> Column:
    """The latest year from 1980 to as_of whose digits are in name, else null."""
    years = F.sequence(F.lit(FIRST_YEAR), F.lit(as_of) if isinstance(as_of, int) else as_of)
    return F.array_max(F.filter(years, lambda y: name.contains(y.cast("string"))))


def without_repeats(c: Column) -> Column:
    """Each word once, where it first stands, in lower case."""
    return F.array_join(F.array_distinct(F.array_remove(F.split(F.lower(c), r"\s+"), "")), " ")


# The marks that names are freed of, and the brackets whose content goes.
MARKS = r"""[-()\\"#/@;:<>{}`+=~|.!?,]"""
IN_BRACKETS = r"[(\[].*?[)\]]"


def punctuation_to_blank(c: Column) -> Column:
    return F.regexp_replace(c, MARKS, " ")


def without_brackets(c: Column) -> Column:
    """Without what stands in round or square brackets, and with blanks for dashes."""
    return stripped(F.replace(F.regexp_replace(c, IN_BRACKETS, ""), F.lit("-"), F.lit(" ")))


def capitalized(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def subsets(words: Column) -> Column:
    """All non-empty choices of up to MOST_WORDS words, in order, joined by blanks; null for more words."""
    n = F.size(words)
    masks = F.sequence(F.lit(1), F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2), n).cast("int") - 1)
    pick = lambda m: F.array_join(F.filter(words, lambda w, i: F.floor(m / F.pow(F.lit(2), i)).cast("long") % 2 == 1), " ")
    return F.when((n > 0) & (n <= MOST_WORDS), F.transform(masks, pick)).when(n == 0, F.array().cast("array<string>"))


def powerset(words: Column) -> Column:
    """All choices of the words as they are, in lower case, title case, capitalised and in upper case; sorted, each once."""
    forms = [words, F.transform(words, F.lower), F.transform(words, F.initcap), F.transform(words, capitalized), F.transform(words, F.upper)]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[subsets(f) for f in forms]))))


def clean_model(model: Column, year: Column) -> Column:
    """A register's model name without its model year: parts between commas that hold the year, MY and the year's last
    digits, or a short MY mark go; without a comma a trailing MY mark goes. If nothing is left the name stays."""
    long, short = year.cast("string"), F.substring(year.cast("string"), 3, 2)
    parts = F.transform(F.split(model, ","), stripped)
    marked = lambda p: F.lower(p).contains("my")
    kept = F.array_join(F.filter(parts, lambda p: ~(p.contains(long) | (marked(p) & (p.contains(short) | (F.length(p) <= 4))))), "  ")
    ended = F.when(model.endswith(F.concat(F.lit("MY"), long)), F.expr("true")).otherwise(False)
    single = F.when(ended, F.substring(model, F.lit(1), F.length(model) - 6)).when(model.endswith(F.concat(F.lit("MY"), short)), F.substring(model, F.lit(1), F.length(model) - 4)).otherwise(model)
    out = stripped(F.when(F.size(parts) > 1, kept).otherwise(single))
    return F.when(out == "", stripped(model)).otherwise(out)


def before_single_comma(name: Column) -> Column:
    """The part before the comma of a name with just one; other names stay."""
    parts = F.split(name, ",")
    return F.when(F.size(parts) == 2, stripped(parts[0])).otherwise(name)


def words(c: Column) -> Column:
    """Lower-case runs of word characters."""
    return F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), "")


def relevant_words(sentence: Column, model_words: Column, others: Column) -> Column:
    """The words of a sentence without those of others (other brands and models, but never the model's own), if one of
    them belongs to the model or is a telling word, or the sentence has a digit; else null."""
    left = F.array_except(sentence, F.array_except(others, model_words))
    telling = F.array_union(model_words, F.array(*[F.lit(w) for w in RELEVANT_WORDS]))
    return F.when(F.arrays_overlap(left, telling) | F.array_join(sentence, " ").rlike(r"\d"), F.array_join(left, " "))


def locale_number(c: Column) -> Column:
    """A number written with a decimal comma and dots between thousands, or with one dot alone, which is then the
    decimal mark; null if it isn't a number."""
    plain = (F.length(c) - F.length(F.replace(c, F.lit("."), F.lit(""))) == 1) & ~c.contains(",")
    return F.when(plain, c).otherwise(F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).try_cast("double")


def unique_name(model: Column, year: Column) -> Column:
    return F.concat(folded(model), F.coalesce(year.cast("string"), F.lit("")))


def key_of(*parts: Column) -> Column:
    """The md5 key of the parts' text, each stripped, end to end; null reads as None, like in the stored keys."""
    return F.md5(F.concat(*[stripped(F.coalesce(p.cast("string"), F.lit("None"))) for p in parts]))
