"""Best-fit packing: token sequences of a fixed length, as full as they can be, with no document cut that fits in one."""

from __future__ import annotations

import bisect
import json
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType

from .common import give_back, give_memory_back, materialize, own_columns, small_batches

CAPACITY, END_ID = 1024, 2
#: Runs of text between blanks whose tokens a task remembers, and the longest that it does.
REMEMBERED, LONGEST = 250_000, 64
#: Rows that are ranked together at most.
ROWS = 200_000
# The pattern that splits text for byte-level vocabularies of this kind, and the printable bytes that stand for
# themselves in them; the other bytes follow from code point 256 on.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
# Characters that all libraries class alike: up to Cyrillic, and general punctuation.
_OTHER = re.compile("[^\x00-ԯ -⁯]")


class Tokens(dict):
    """From a run of text to the bytes of its token ids (little-endian, 32 bits), with a blank before it.

    A cut before a blank is never inside a token unless there is white space on both sides of it, so a text's ids are those of
    its runs between blanks, and the frequent runs are remembered. Runs are encoded by merge ranks, which give what the tokenizer
    gives; texts with more white space together, or with rare characters, go through the tokenizer as a whole, as does all text
    if the vocabulary isn't the plain byte-level one.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, vocabulary = told["model"], told["model"]["vocab"]
        chars = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
        special = {x["content"] for x in told["added_tokens"]}
        plain = told["normalizer"] is None and told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        plain &= model["type"] == "BPE" and not any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        plain &= all(vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) == 256 + i for i, m in enumerate(model["merges"]))
        self.ranks = None
        if plain:
            ranks = {bytes(chars[c] for c in s): i for s, i in vocabulary.items() if s not in special}
            self.ranks = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.marks = {m: array("I", self.ranks.encode_ordinary(m)).tobytes() for m in ".,;:!?"}

    def __missing__(self, run: str) -> bytes | None:
        """None: what has the run must be encoded as a whole."""
        if not run or run[0].isspace() or not run.isascii() and _OTHER.search(run):
            return None
        if run[-1] in self.marks and run[:-1].isalnum():
            found = self[run[:-1]] + self.marks[run[-1]]
        else:
            found = array("I", self.ranks.encode_ordinary(" " + run)).tobytes()
        if len(self) < REMEMBERED and len(run) <= LONGEST:
            self[run] = found
        return found

    def encode(self, text: str) -> bytes:
        first, *runs = text.split(" ")
        if self.ranks is not None and not _OTHER.search(first):
            try:
                return array("I", self.ranks.encode_ordinary(first)).tobytes() + b"".join(map(self.__getitem__, runs))
            except TypeError:
                pass
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


_TOKENS: dict[str, Tokens] = {}


def tokenized(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """docs without text, and a row for each piece of a document: piece, start, length and tokens, the ids as little-endian
    32-bit numbers. A document is the ids of its whole text by the tokenizer file at path, without special tokens, and then
    end_id. Only a document of more than capacity ids is cut, from its end, so that its first piece may be shorter. A null text
    reads as empty. Nothing is shuffled; a worker remembers the ids of up to REMEMBERED runs of text."""
    small_batches(docs.sparkSession)
    rows = docs.select(own_columns(docs, text), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    schema = StructType([rows.schema["own"]]).add("piece", IntegerType()).add("start", LongType()).add("length", LongType()).add("tokens", BinaryType())
    end = array("I", [end_id]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENS:
            _TOKENS[path] = Tokens(path)
        known = _TOKENS[path]
        for batch in batches:
            of, columns = [], ([], [], [], [])
            for i, x in enumerate(batch.column("text").to_pylist()):
                ids = known.encode(x) + end
                n = len(ids) // 4
                starts = [0, *range((n - 1) % capacity + 1, n, capacity)] if n > capacity else [0]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                    of.append(i)
                    for c, v in zip(columns, (k, a, b - a, ids[4 * a : 4 * b])):
                        c.append(v)
            made = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("own").take(pa.array(of, pa.int64())), *made], ["own", "piece", "start", "length", "tokens"])
        give_memory_back()

    return give_back(rows.mapInArrow(cut, schema), "piece", "start", "length", "tokens")


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Best fit of counts[size] documents of each size, from large to small, as (first, each, place, size): documents by rank, the
    largest first, stand from rank first on, each of them to a sequence, in neighbouring sequences that are filled alike. place is
    that of the first of them, with all sequences laid end to end.

    A document takes the smallest gap that holds it, and then what is left of that gap is the smallest for the next one of its
    size. So a step fills any number of equal gaps at once, and there are as many steps as sizes and the gaps that they meet, however
    many documents there are: a size splits one group of equal gaps in three, and less than sqrt(2 * capacity) sizes fit in one gap.
    """
    found, gaps, alike = [], [], {}  # sizes of gaps, ascending, and for each (first sequence, sequences) of those that have it
    rank = opened = 0

    def free(gap: int, bin_: int, n: int) -> None:
        if gap and n:
            if gap not in alike:
                bisect.insort(gaps, gap)
            alike.setdefault(gap, []).append((bin_, n))

    for size, left in sorted(counts.items(), reverse=True):
        while left:
            i = bisect.bisect_left(gaps, size)
            if i == len(gaps):
                gap, bin_, n = capacity, opened, -(-left // (capacity // size))
                opened += n
            else:
                gap = gaps[i]
                bin_, n = alike[gap].pop()
                if not alike[gap]:
                    del gaps[i], alike[gap]
            each = gap // size
            docs = min(left, n * each)
            full, more = divmod(docs, each)
            found.append((rank, each, bin_ * capacity + capacity - gap, size))
            free(gap - each * size, bin_, full)
            if more:
                free(gap - more * size, bin_ + full, 1)
            used = full + (more > 0)
            free(gap, bin_ + used, n - used)
            rank, left = rank + docs, left - docs
    return found


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", rows_per_task: int = ROWS) -> DataFrame:
    """pieces with sequence_id and offset: each row of length 1 to capacity has a place in a sequence of at most capacity, and
    the places of a sequence follow each other without gaps from 0.

    Best fit from large to small, with as many sequences as one pass over all rows in that order makes. Which places there are
    follows from the number of rows of each length alone (see best_fit): the driver gets these, capacity numbers at most. Which
    row has which place follows from its rank: rows are ranked within their length, in runs of up to rows_per_task rows of a
    partition, and the counts of earlier runs are added, so that a common length is not one task's. There are no rounds: the
    number of jobs depends neither on the rows nor on the tasks. Rows that repeat are packed each. A length outside 1 to
    capacity, or a null one, is an error.
    """
    spark = pieces.sparkSession
    small_batches(spark)
    # an id has the number of its partition in the upper bits, so that a run is of one partition but at the borders of these
    table = materialize(pieces.select(own_columns(pieces), F.col(f"`{length}`").cast("long").alias("size"), F.monotonically_increasing_id().alias("id")), "pieces")
    right = F.when(F.col("size").between(1, capacity), F.col("size"))
    counts = {r["size"]: r["n"] for r in table.groupBy(right.alias("size")).agg(F.count("*").alias("n")).collect()}
    if None in counts:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    first, each, place, of_size = np.array(best_fit(counts, capacity), np.int64).reshape(-1, 4).T

    @F.arrow_udf("long")
    def placed(ranks: pa.Array) -> pa.Array:
        rank = ranks.to_numpy(zero_copy_only=False)
        i = np.searchsorted(first, rank, "right") - 1
        bins, nth = np.divmod(rank - first[i], each[i])
        return pa.array(place[i] + bins * capacity + nth * of_size[i])

    sizes = sorted(counts, reverse=True)
    larger = spark.createDataFrame(list(zip(sizes, accumulate((counts[s] for s in sizes), initial=0))), "size long, larger long")
    rows = table.withColumn("run", F.expr(f"id div {rows_per_task}"))
    earlier = F.sum("n").over(Window.partitionBy("size").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    runs = rows.groupBy("run", "size").agg(F.count("*").alias("n")).withColumn("earlier", F.coalesce(earlier, F.lit(0))).join(F.broadcast(larger), "size")
    within = F.row_number().over(Window.partitionBy("run", "size").orderBy("id")) - 1
    ranked = rows.withColumn("within", within).join(runs, ["run", "size"])
    found = ranked.select("own", placed(F.col("larger") + F.col("earlier") + F.col("within")).alias("place"))
    return give_back(found, F.expr(f"place div {capacity}").alias("sequence_id"), (F.col("place") % capacity).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, tokens) of pieces that have tokens (see tokenized) and a place (see pack): the ids of a sequence's pieces end
    to end. A sequence has at most its capacity of ids."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "tokens"))).alias("x"))
    hexes = F.array_join(F.transform("x", lambda p: F.hex(p["tokens"])), "")
    return rows.select("sequence_id", F.unhex(hexes).alias("tokens"))


