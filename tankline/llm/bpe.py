"""Byte-level BPE: encoding by replaying the merges over the words of a block of the corpus, and decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_memory_back, small_batches

#: A block of the corpus whose words are merged together, in characters, and the bytes of words in one replay.
BLOCK_CHARS = 4_000_000
REPLAY_BYTES = 4_000_000
#: Pieces of text that are remembered between blocks, none of more than so many characters.
MEMORY_PIECES, MEMORY_CHARS = 250_000, 48
NONE = np.int32(1 << 30)
#: Fixed value: the pattern that the shortcuts of Encoder rest on; with any other, whole texts go through the pattern.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Vocabulary:
    """Ranks by bytes, and for each pair of tokens the token that it merges to."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines() if rank_file else [])}
        self.pattern = regex.compile(pattern)
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        get = self.ranks.get
        pairs = [(a << 32 | b, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (a := get(t[:i])) is not None and (b := get(t[i:])) is not None]
        pairs.sort()
        self.keys, self.merged = np.array([p[0] for p in pairs] or [-1], np.int64), np.array([p[1] for p in pairs] or [NONE], np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, NONE for those that don't merge."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def one(self, word: bytes) -> list[int]:
        """A single word, by the definition: always the lowest rank, of equal ones the leftmost."""
        parts = [bytes([x]) for x in word]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], NONE), i))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of distinct non-empty words, end to end, and where each word's begin (one more entry than words).

        All words lie in one array of symbols. An inverted index leads from a pair's rank to the positions that have the
        pair; merges are applied in rank order, each to all its positions at once, and only the pairs to the left and
        right of a merge are looked up anew and added to the index. Words in which a merge makes a pair of no higher rank
        than its own, which can't be replayed in this order, are done again one by one.
        """
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.r_[0, np.cumsum(lengths)]
        n = int(starts[-1])
        sym = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[starts[1:] - 1], before[starts[:-1]] = n, -1
        pair = np.full(n + 1, NONE, np.int32)
        inner = np.flatnonzero(after < n)
        pair[inner] = self.rank(sym[inner], sym[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray, ranks: np.ndarray) -> None:
            some = ranks < NONE
            at, ranks = at[some], ranks[some]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[np.r_[0, cuts]].tolist(), np.split(at, cuts) if len(cuts) else [at]):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        add(inner, pair[inner])
        again: set[int] = set()
        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            at = at[pair[at] == r]
            if len(at) > 1:
                touch = np.r_[False, after[at[:-1]] == at[1:]]
                if touch.any():  # in a run of overlapping pairs every other one merges, from the left
                    run = np.maximum.accumulate(np.where(touch, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - run) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            right = after[gone]
            sym[at], after[at] = r, right
            sym[gone], pair[gone] = -1, NONE
            more = right < n
            before[right[more]] = at[more]
            pair[at] = NONE
            pair[at[more]] = self.rank(sym[at[more]], sym[right[more]])
            left = before[at]
            less = left >= 0
            left = left[less]
            pair[left] = self.rank(sym[left], sym[at[less]])
            touched = np.unique(np.r_[at[more], left])
            ranks = pair[touched]
            if (ranks <= r).any():
                again.update(owner[touched[ranks <= r]].tolist())
            add(touched, ranks)
        live = sym >= 0
        flat, counts = sym[live], np.bincount(owner[live], minlength=len(words))
        if again:
            parts = np.split(flat, np.cumsum(counts)[:-1])
            for w in again:
                parts[w] = np.array(self.one(words[w]), np.int32)
            flat, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        return flat, np.r_[0, np.cumsum(counts)]


def ragged(flat: np.ndarray, offsets: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows pick of a ragged array, end to end, and their lengths."""
    lengths = offsets[pick + 1] - offsets[pick]
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[pick] - (ends - lengths), lengths)
    return flat[at], lengths


@lru_cache(maxsize=2)
def vocabulary(rank_file: bytes, pattern: str) -> Vocabulary:
    """Built once in a Python worker, which serves many tasks."""
    return Vocabulary(rank_file, pattern)


@lru_cache(maxsize=2)
def token_bytes(rank_file: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens end to end, and where each token's begin; read once in a Python worker."""
    known = {int(b): base64.b64decode(a) for a, b in map(bytes.split, rank_file.splitlines())}
    tokens = [known.get(i, b"") for i in range(max(known, default=-1) + 1)]
    return np.frombuffer(b"".join(tokens), np.uint8), np.r_[0, np.cumsum([len(t) for t in tokens])].astype(np.int64)


class Encoder:
    """Encodes texts block by block; short pieces of text that came up before are remembered.

    With WORD_PATTERN a text is cut at each blank that stands between two characters that aren't white space: a match ends
    before such a blank, so none crosses the cut. A piece is the blank and what follows it up to the next cut (in heads: a
    text's first piece, without a blank). Long pieces are forgotten with their block. When more than MEMORY_PIECES are
    known, those that the last block did not use go, and then as many as are too many, so that memory is bounded.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.shortcuts = vocabulary.pattern.pattern == WORD_PATTERN
        self.pieces: dict[str, int] = {}
        self.heads: dict[str, int] = {}
        self.flat, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _words(self, piece: str) -> list[str]:
        if self.shortcuts:
            word = piece[1:] if piece[:1] == " " else piece
            if word.isalpha():
                return [piece]
            if word[:-1].isalpha() and word[-1] in ".,":
                return [piece[:-1], word[-1]]
        return self.vocabulary.pattern.findall(piece)

    def _learn(self, fresh: list[str]) -> None:
        """Append the tokens of these pieces to flat, by replays of a bounded number of bytes."""
        flats, ends, last = [self.flat], [self.offsets], self.offsets[-1]
        at = 0
        while at < len(fresh):
            words: dict[str, int] = {}
            counts, of_piece, size = [], [], 0
            while at < len(fresh) and size < REPLAY_BYTES:
                found = self._words(fresh[at])
                before = len(words)
                of_piece += [words.setdefault(w, len(words)) for w in found]
                size += len(fresh[at]) if len(words) > before else 0
                counts.append(len(found))
                at += 1
            flat, offsets = self.vocabulary.replay([w.encode() for w in words])
            tokens, lengths = ragged(flat, offsets, np.array(of_piece, np.int64))
            flats.append(tokens)
            ends.append(last + np.r_[0, np.cumsum(lengths)][np.cumsum(counts)])
            last = ends[-1][-1]
        self.flat, self.offsets = np.concatenate(flats), np.concatenate(ends)

    def _forget(self, rows: list[np.ndarray]) -> None:
        """Keep the pieces that may be remembered, and renumber them."""
        if len(self.pieces) + len(self.heads) > MEMORY_PIECES:
            used = np.zeros(len(self.offsets), bool)
            for row in rows:
                used[row] = True
            for known in (self.pieces, self.heads):
                kept = [(k, i) for k, i in known.items() if used[i]]
                known.clear()
                known.update(kept[:MEMORY_PIECES // 2])
        elif len(self.offsets) - 1 == len(self.pieces) + len(self.heads):
            return
        kept = np.array([*self.pieces.values(), *self.heads.values()], np.int64)
        self.flat, lengths = ragged(self.flat, self.offsets, kept)
        self.offsets = np.r_[0, np.cumsum(lengths)]
        self.pieces = dict(zip(self.pieces, range(len(self.pieces))))
        self.heads = dict(zip(self.heads, range(len(self.pieces), len(kept))))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        known, heads, fresh, rows, base = self.pieces, self.heads, [], [], len(self.offsets) - 1
        long: list[tuple[dict[str, int], str]] = []
        for text in texts:
            if not text:
                rows.append(np.zeros(0, np.int64))
                continue
            first, *rest = text.split(" ") if self.shortcuts else (text,)
            new = set(rest).difference(known)
            if rest and (not first or first[-1].isspace() or "" in new or any(x[0].isspace() or x[-1].isspace() for x in new)):
                first, *rest = _CUT.split(text)
                new = set(rest).difference(known)
            for piece in new:
                known[piece] = base + len(fresh)
                fresh.append(" " + piece)
                if len(piece) > MEMORY_CHARS:
                    long.append((known, piece))
            if first not in heads:
                heads[first] = base + len(fresh)
                fresh.append(first)
                if len(first) > MEMORY_CHARS:
                    long.append((heads, first))
            row = np.empty(len(rest) + 1, np.int64)
            row[0] = heads[first]
            row[1:] = np.fromiter(map(known.__getitem__, rest), np.int64, len(rest))
            rows.append(row)
        if fresh:
            self._learn(fresh)
        out = [ragged(self.flat, self.offsets, row)[0] for row in rows]
        for pieces, piece in long:
            del pieces[piece]
        self._forget(rows)
        return out


def _blocks(batches: Iterator[pa.Array]) -> Iterator[list[str]]:
    held, size = [], 0
    for batch in batches:
        for text in batch.to_pylist():
            held.append(text or "")
            size += len(held[-1])
            if size >= BLOCK_CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """docs with the token ids of the whole text, array<int>; a column of that name is replaced.

    rank_path: a file of base64 tokens and their ranks; it is read once on the driver and sent to the tasks, as are the
    ids that the tiktoken library gives for ordinary text, each match of pattern by itself, without special tokens. Null
    and empty texts have no ids; repeated rows get the same. Rows are encoded where they lie; nothing is shuffled, and a
    task holds one block of texts (a longer text is a block by itself) and a bounded number of remembered short pieces.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(rank_path, "rb") as file:
        held = spark.sparkContext.broadcast(file.read())

    @F.arrow_udf("array<int>")
    def of_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(vocabulary(held.value, pattern))
        for block in _blocks(batches):
            rows = encoder.encode(block)
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                offsets = np.r_[0, np.cumsum([len(r) for r in part])].astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(part).astype(np.int32)))
        del encoder
        give_memory_back()

    return docs.withColumn(ids, of_text(F.col(text)))


def _lists(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a batch end to end, and how many each row has; a null row has none."""
    lengths = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.list_flatten(batch).to_numpy(zero_copy_only=False), lengths


def decode(docs: DataFrame, rank_path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """docs with the bytes that the token ids stand for, as binary (ids may cut a character in two). Null ids give no
    bytes; an id that isn't in the vocabulary is an error. A column of that name is replaced."""
    spark = docs.sparkSession
    with open(rank_path, "rb") as file:
        held = spark.sparkContext.broadcast(file.read())

    @F.arrow_udf("binary")
    def of_ids(batch: pa.Array) -> pa.Array:
        tokens, starts = token_bytes(held.value)
        flat, counts = _lists(batch)
        if len(flat) and not (0 <= flat.min() and flat.max() < len(starts) - 1 and (starts[flat + 1] > starts[flat]).all()):
            raise ValueError("an id is not in the vocabulary")
        data, lengths = ragged(tokens, starts, flat.astype(np.int64))
        ends = np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(counts)]].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])

    return docs.withColumn(out, of_ids(F.col(ids)))


def with_id_digest(docs: DataFrame, ids: str = "token_ids", out: str = "ids_sha256") -> DataFrame:
    """docs with the SHA-256 of the ids as little-endian unsigned 32-bit integers; null ids are none."""

    @F.arrow_udf("string")
    def of_ids(batch: pa.Array) -> pa.Array:
        flat, counts = _lists(batch)
        data, ends = flat.astype("<u4").tobytes(), 4 * np.r_[0, np.cumsum(counts)]
        return pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.string())

    return docs.withColumn(out, of_ids(F.col(ids)))
