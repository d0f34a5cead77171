"""Packing token sequences: shortest pack first over the histogram of lengths.

Each document is tokenised, ended with an id, and cut into full sequences and
one shorter rest.  Only the histogram of piece lengths (as many rows as a
sequence has tokens, at most) reaches the driver.  There lengths are placed
longest first, each into the shortest open pack that it fits; what is kept are
packing patterns with counts, whose number depends on the histogram's width and
not on the corpus.  Pieces find their place by rank among those of their length.

Null and empty texts have the end id alone.  Repeated rows are packed each.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memory, cut, texts

END = 1
SEQUENCE = 2048

#: Texts of these characters alone need no normalisation but lower case.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÿ]*")
#: The pre-tokens of the vocabulary's public pattern, for plain lower-cased text.
_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class WordTokenizer:
    """Exact ids of the word BPE tokenizer, each distinct pre-token encoded once.

    Plain texts are cut into pre-tokens here.  Other texts, and texts that may
    hold a special token's string, are cut at ASCII white space only, over
    which the tokenizer never joins.
    """

    def __init__(self, path: str, memory: int = 700_000) -> None:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        self.known = Memory(lambda word: np.array(own.encode(word, add_special_tokens=False).ids, "<u4").tobytes(), memory)

    def __call__(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if _PLAIN.fullmatch(text) and "<|" not in text:
            words = _WORDS.findall(text.lower())
        else:
            words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.known.__getitem__, words))


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pack_histogram(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, list[int]]]:
    """Patterns (count, lengths) that hold each length as often as ``counts`` says."""
    open_: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)  # by room left
    done: list[tuple[int, list[int]]] = []

    def put(count: int, pattern: list[int], room: int) -> None:
        if room:
            open_[room].append((count, pattern))
        else:
            done.append((count, pattern))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= size:
            raise ValueError("a length beyond the sequence")
        left = counts[length]
        # the shortest pack has most room
        for room in sorted((r for r in open_ if r >= length and open_[r]), reverse=True):
            while left and open_[room]:
                n, pattern = open_[room].pop()
                used = min(n, left)
                if n > used:
                    open_[room].append((n - used, pattern))
                put(used, [*pattern, length], room - length)
                left -= used
            if not left:
                break
        if left:
            put(left, [length], size - length)
    for packs in open_.values():
        done += packs
    return done


def slots(patterns: list[tuple[int, list[int]]]) -> tuple[np.ndarray, ...]:
    """(length, first rank, sequence of that rank, offset), sorted by the first two."""
    rows, taken, base = [], defaultdict(int), 0
    for count, pattern in sorted(patterns, key=lambda p: (p[1], p[0]), reverse=True):
        offset = 0
        for length in pattern:
            rows.append((length, taken[length], base, offset))
            taken[length] += count
            offset += length
        base += count
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return tuple(table[:, i] for i in range(4))


def pieces(docs: DataFrame, tokenizer: Callable[[], Callable[[str], bytes]], size: int = SEQUENCE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, part, rank): ``rank`` counts a length within its task."""
    end = np.array([END], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        encode, seen, part = tokenizer(), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                ids = encode(batch.column(1)[i].as_py()) + end
                total = len(ids) // 4
                for at in range(0, total, size):
                    body = ids[4 * at : 4 * (at + size)]
                    n = len(body) // 4
                    rows.append((batch.column(0)[i].as_py(), at, n, crc32(body), total, part, int(seen[n])))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return texts(docs).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long")


def pack(docs: DataFrame, path: str, size: int = SEQUENCE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row for each piece.

    The pieces (some fifty bytes each, without their ids) are checkpointed:
    their task-local ranks are then fixed, also after a lost executor.
    """
    cut_up = cut(pieces(docs, lambda: _tokenizer(path), size))
    totals = cut_up.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in totals.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(pack_histogram(histogram, size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = cut_up.join(firsts, ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("rank")).alias("rank"))

    def place(batches):
        lengths, ranks, bases, offsets = table
        starts = {n: np.searchsorted(lengths, [n, n + 1]) for n in np.unique(lengths).tolist()}
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            where = np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                low, high = starts[n]
                own = length == n
                where[own] = low + np.searchsorted(ranks[low:high], rank[own], side="right") - 1
            sequence, offset = bases[where] + rank - ranks[where], offsets[where]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
