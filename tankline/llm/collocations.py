"""Phrase collocation mining: phrases of two to four words that are frequent and hold together, for each language."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import again, byte_words, discard, give_memory_back, hot_join, materialize, small_batches

MIN_COUNT, LONGEST, TOP, SCALE = 30, 4, 2000, 2_000_000
#: A phrase goes that a longer one with this share of its occurrences, in hundredths, has in it.
INSIDE = 80
#: Bytes of text in a block of the occurrence relation.
BLOCK_BYTES = 18 << 20
#: What stands in the relation where no phrase begins.
NONE = -1
# A-Z in lower case, the marks that end a piece as line breaks, tabs as blanks. Line breaks are made words of their own.
_MARKS = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_BREAK = b"\n"
#: Bits of a group's number that are its place in its block, and of a block's that are its place in its task.
CODE_BITS, BLOCK_BITS = 31, 12
_WORDS = pa.schema([("block", pa.int64()), ("code", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("relation", pa.binary())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("uid", pa.int64()), ("n", pa.int64())])
_RELATION = pa.schema([("block", pa.int64()), ("relation", pa.binary()), ("gids", pa.binary())])
_DDL = {"int64": "long", "int32": "int", "string": "string", "binary": "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[str(f.type)]}" for f in schema)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers as bytes of one rank after those of another, which compress better."""
    ranks = numbers.reshape(-1, 1).view(np.uint8).T
    return len(numbers).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(ranks).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    ranks = np.frombuffer(pa.decompress(data[8:], width * n, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(ranks.T).view(kind).reshape(n)


def _batches(schema: pa.Schema, size: int, **columns) -> Iterator[pa.RecordBatch]:
    for first in range(0, size, 50_000):
        rows = min(50_000, size - first)
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name][first : first + rows], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


class _Block:
    """Occurrences of words in the texts of a block: a code for each place in order, NONE where a piece ends."""

    def __init__(self):
        self.next, self.size, self.parts, self.codes = count(), 0, [], {}

    def add(self, lang: str, text: bytes) -> None:
        if lang not in self.codes:
            self.codes[lang] = defaultdict(self.next.__next__, {_BREAK: NONE})
        known = self.codes[lang]
        for words in byte_words(text.translate(_MARKS).replace(b"\n", b" \n "), keep_breaks=True):
            self.parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        self.parts.append(np.array([NONE], np.int32))
        self.size += len(text)

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        """A row for each word, with its count, and then one with the block's relation."""
        codes = np.concatenate(self.parts)
        self.parts.clear()
        size = next(self.next)
        n, langs, words = np.bincount(codes[codes != NONE], minlength=size), [""] * size, [""] * size
        yield from _batches(_WORDS, 1, block=[block], relation=[_packed(codes)])
        del codes
        for lang, known in self.codes.items():
            for w, c in known.items():
                if c != NONE:
                    langs[c], words[c] = lang, w.decode()
            known.clear()
        yield from _batches(_WORDS, size, block=np.full(size, block), code=np.arange(size), lang=langs, word=words, n=n)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The relation of single words, block by block, and the words of each block with their counts."""
    task, block, made = pyspark.TaskContext.get().partitionId(), _Block(), 0

    def rows() -> Iterator[pa.RecordBatch]:
        if made >> BLOCK_BITS or task >> (63 - CODE_BITS - BLOCK_BITS):
            raise ValueError("too many blocks in a task, or tasks: set spark.sql.files.maxPartitionBytes")
        return block.rows(task << BLOCK_BITS | made)

    for batch in batches:
        for lang, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "text"))):
            block.add(lang, text)
            if block.size > BLOCK_BYTES:
                yield from rows()
                block, made = _Block(), made + 1
    if block.parts:
        yield from rows()
    give_memory_back()


def _joined(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The merge join of a block's relation with itself at adjacent places: the places where a phrase begins at both, the pair of
    codes there as one number, and what pairs are made by."""
    begins, width = codes != NONE, int(codes.max(initial=0)) + 1
    at = np.flatnonzero(begins[:-1] & begins[1:])
    return at, codes[at].astype(np.int64) * width + codes[at + 1], width


def _counted(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers of an array, sorted, and how often each is there; the array is used up."""
    joined.sort()
    first = np.flatnonzero(np.r_[True, joined[1:] != joined[:-1]]) if len(joined) else np.zeros(0, np.int64)
    return joined[first], np.diff(np.r_[first, len(joined)])


def _longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The groups one word longer of each block, with their counts: (a, b) are its first and its last words' phrases."""
    for batch in batches:
        for block, relation, gids in zip(*(batch.column(c).to_pylist() for c in ("block", "relation", "gids"))):
            known = _unpacked(gids, np.int64)
            _, joined, width = _joined(_unpacked(relation, np.int32))
            pairs, n = _counted(joined)
            yield from _batches(_PAIRS, len(pairs), a=known[pairs // width], b=known[pairs % width], uid=(block << CODE_BITS) + np.arange(len(pairs)), n=n)
    give_memory_back()


def _semi_joined(first: bool):
    def keep(relation: pa.Table, frequent: pa.Table) -> pa.Table:
        """A block's relation of frequent phrases, from its relation of words, or of phrases one word shorter, and its frequent
        groups (code, gid): what begins at each place, numbered anew, and these numbers' phrases."""
        if not relation.num_rows or not frequent.num_rows:
            return _RELATION.empty_table()
        codes = _unpacked(relation.column("relation")[0].as_py(), np.int32)
        code, gid = (frequent.column(c).to_numpy() for c in ("code", "gid"))
        order = np.argsort(code)
        code, gid = code[order], gid[order]
        if first:
            anew = np.full(max(int(codes.max(initial=0)), int(code[-1])) + 2, NONE, np.int32)  # the last is for NONE
            anew[code] = np.arange(len(code), dtype=np.int32)
            codes = anew[codes]
        else:
            at, joined, _ = _joined(codes)
            often = _counted(joined.copy())[0][code]  # the pairs of the frequent groups, sorted as their codes are
            codes = np.full(len(codes), NONE, np.int32)
            place = np.minimum(np.searchsorted(often, joined), len(often) - 1).astype(np.int32)
            codes[at] = np.where(often[place] == joined, place, NONE)
        return pa.table({"block": [relation.column("block")[0].as_py()], "relation": [_packed(codes)], "gids": [_packed(gid)]}, schema=_RELATION)

    return keep


def _described(phrases: DataFrame, shorter: DataFrame, side: str, *columns: str) -> DataFrame:
    """phrases with columns of the shorter phrase on one side; a part that many phrases have meets them by broadcast."""
    weights = phrases.groupBy(side).agg(F.count("*").alias("degree"))
    named = shorter.select(F.col("gid").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]).join(weights, side)
    return hot_join(phrases, named, side, "degree", phrases.count()).drop("degree")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int | None = TOP, longest: int = LONGEST, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): for each language its top phrases of 2 to longest words with at least min_count
    occurrences; top None gives all of them.

    Texts, A-Z in lower case, are split at .,;:!? and line breaks into pieces and these at blanks and tabs into words. n counts
    the language's words, a the phrase's occurrences within pieces, overlaps included. Cut after its first k words a phrase has l
    and r, the occurrences of its parts, and floor(2000000 a / (l + r)); the least of these is its score (of equal ones the
    least k's). A phrase goes if a longer frequent one has it inside, and at least 80 % of its occurrences.

    Set-oriented mining. The occurrence relation of a length, which phrase begins at each place, is persisted in blocks of texts,
    sorted by place; pieces lie apart. Groups of the next length come from its merge join with itself at adjacent places, within
    a block as blocks are sorted. They are counted within blocks, and then over all blocks in one shuffle by group, in which those
    that are not frequent end; the frequent ones return to their blocks, and the relation, semi-joined with them, is persisted
    before it is extended. What is shuffled is a row for each group of a block, however often it occurs there, and the packed
    blocks. A phrase is known by a number and by those of its first and last words' phrases, so counts of parts come by joins of
    frequent phrases alone.

    Null texts read as '', null languages as 'und'. Each row counts, repeated or not. Other columns are left aside; an empty table,
    or one without frequent phrases, gives no rows. Products are decimals of 38 digits.
    """
    small_batches(docs.sparkSession)
    asked = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    found = asked.mapInArrow(_occurrences, _ddl(_WORDS)).withColumn("words", F.col("relation").isNull())
    found = materialize(found, "occurrences", "words", release=True)
    groups = found.filter("words").select("lang", "word", F.expr(f"shiftleft(block, {CODE_BITS}) + code").alias("uid"), "n")
    totals = materialize(groups.groupBy("lang").agg(F.sum("n").alias("n")), "words-by-language")
    relation, keys, described, phrases = found.filter("not words").select("block", "relation"), ["lang", "word"], None, []
    for k in range(1, longest + 1):
        group = Window.partitionBy(*keys)
        counted = groups.withColumns({"f": F.sum("n").over(group), "gid": F.min("uid").over(group)}).filter(F.col("f") >= min_count)
        told = [F.when(F.col("uid") == F.col("gid"), F.col(c)).alias(c) for c in ("f", *keys)]  # once for each group
        counted = materialize(counted.select("uid", "gid", *told), f"frequent-{k}", release=True)
        frequent = counted.filter("f is not null").drop("uid")
        if k == 1:
            described = frequent.select("gid", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("starts"), F.array("f").alias("ends"))
            described = materialize(described, "phrases-1", release=True)
            discard(found, "words=true")
        else:
            pairs = _described(_described(frequent, described, "a", "lang", "phrase", "starts"), described, "b", "last", "ends")
            starts, ends = F.concat("a_starts", F.array("f")), F.concat("b_ends", F.array("f"))
            described = pairs.select("gid", "a", "b", F.col("a_lang").alias("lang"), F.concat_ws(" ", "a_phrase", "b_last").alias("phrase"), F.col("b_last").alias("last"), "f", starts.alias("starts"), ends.alias("ends"))
            described = materialize(described, f"phrases-{k}", release=True)
            phrases.append((k, described))
        if k < longest:
            back = counted.select(F.expr(f"shiftright(uid, {CODE_BITS})").alias("block"), F.expr(f"cast(uid & {(1 << CODE_BITS) - 1} as int)").alias("code"), "gid")
            kept = materialize(relation.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_semi_joined(k == 1), _ddl(_RELATION)), f"occurrences-{k}", release=True)
            discard(found)
            discard(counted)
            found, relation, groups, keys = kept, kept, again(kept).mapInArrow(_longer, _ddl(_PAIRS)), ["a", "b"]
    discard(found)
    out = None
    for i, (k, own) in enumerate(phrases):
        if i + 1 < len(phrases):
            longer = phrases[i + 1][1]
            most = longer.select(F.inline(F.array(F.struct(F.col("a").alias("gid"), "f"), F.struct(F.col("b").alias("gid"), "f")))).groupBy("gid").agg(F.max("f").alias("longer"))
            own = own.join(most, "gid", "left").filter(f"longer is null or 100 * longer < {INSIDE} * f")
        score = lambda j: F.expr(f"(cast(f as decimal(20,0)) * {SCALE}) div cast(starts[{j - 1}] + ends[{k - j - 1}] as decimal(20,0))")  # noqa: B023, E731
        cuts = [F.struct(score(j).alias("score"), F.lit(j).alias("k"), F.col("starts")[j - 1].alias("l"), F.col("ends")[k - j - 1].alias("r")) for j in range(1, k)]
        one = own.withColumn("cut", F.array_min(F.array(*cuts))).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
        out = one if out is None else out.unionByName(one)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
