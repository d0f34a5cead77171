"""N-gram Jaccard join by adaptive multi-match prefixes.

A document is the set of its distinct word shingles, as 64-bit fingerprints.
Two sets link at Jaccard similarity ``percent`` / 100 or more, in integers:
100 * |intersection| >= percent * |union|.

Prefixes.  With one global order of tokens, two linked sets share at least l
tokens within their first |x| - ceil(t |x|) + l ones.  A document's l is chosen
by estimated cost: scanning its lists costs the sum of their lengths, and at
most a l-th of those entries can be candidates that need verification.  A pair
is a candidate if it shares the smaller of the two l's.  The order is by the
corpus frequency of a token's cell in a table of fixed size, then by value, so
passages that many documents share come last.  The table's noise changes costs
only; any fixed order gives every link.

Documents with equal sets are one node.  Groups are linked by pivots (see
``graph``), so a large group of copies costs no more than a row for each.

Null and empty texts have an empty set and link with nothing; their component
is their own id.  Rows that repeat an id are separate documents; a component
is named by its smallest id, and is null only if all its ids are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few, map_rows, settle, texts
from .graph import link_groups

#: Cells of the frequency table, and the pieces it travels in.
CELLS, CHUNKS = 1 << 20, 16
#: Longest multi-match, and the cost of a verification in list entries.
MOST, VERIFY = 4, 16

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class _Words(dict):
    """Word to 64-bit hash, in a table of bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, n: int, table: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct fingerprints (uint64) of the n-word shingles of a UTF-8 text.

    Fewer words than n are one shingle, the whole sequence; its length is
    part of the fingerprint.  On bytes, ``lower`` and ``split`` know ASCII only:
    A to Z are lower-cased, and words end at 09 to 0D and 20.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    size = len(words) - width + 1
    total = np.full(size, np.uint64(width), np.uint64)
    for i in range(width):
        total *= _M1
        total += hashed[i : size + i]
    return np.unique(_mix(total))


def first_tokens(tokens: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The first ``length`` tokens by (count, token); counts over a million are alike."""
    rare = np.minimum(counts[(tokens & np.uint64(CELLS - 1)).astype(np.int64)], np.uint32((1 << 20) - 1))
    place = (rare.astype(np.uint64) << np.uint64(44)) | (tokens >> np.uint64(20))
    if length < len(tokens):
        part = np.argpartition(place, length - 1)[:length]
        if np.count_nonzero(place <= place[part].max()) > length:  # a tie at the border
            return tokens[np.lexsort((tokens, rare))[:length]]
        part.sort()
        tokens, place = tokens[part], place[part]
    return tokens[np.argsort(place, kind="stable")]


def fingerprint(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a set; 0 is the empty set's."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63) if len(tokens) else 0


def _describe(docs: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id, text_hash, n, fp), and at the end of each task its frequency table in chunks."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("chunk", pa.int32()), ("task", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, counts, task = _Words(), np.zeros(CELLS, np.uint32), TaskContext.get().partitionId()
        for batch in batches:
            ids, hashes, sizes, prints = batch.column(0), batch.column(2), [], []
            for text in batch.column(1).cast(pa.binary()):
                tokens = shingles(text.as_py(), n, table)
                np.add.at(counts, (tokens & np.uint64(CELLS - 1)).astype(np.int64), np.uint32(1))
                sizes.append(len(tokens))
                prints.append(fingerprint(tokens))
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([ids, hashes, pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        if counts.any():
            for c, part in enumerate(np.split(counts, CHUNKS)):
                yield pa.RecordBatch.from_pylist([{"chunk": c, "task": task, "counts": zlib.compress(part.astype("<u4").tobytes(), 1)}], schema=schema)

    rows = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n int, fp long, chunk int, task int, counts binary")


def _sum_tables(rows: DataFrame) -> DataFrame:
    """Sum the tables of each chunk, streaming: memory for one table in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = np.frombuffer(zlib.decompress(data.as_py()), "<u4")
                if chunk in sums:
                    # counts saturate instead of wrapping
                    sums[chunk] = np.minimum(sums[chunk].astype(np.uint64) + raw, 0xFFFFFFFF).astype("<u4")
                else:
                    sums[chunk] = raw.copy()
        for chunk, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)])], names=["chunk", "counts"])

    return rows.mapInArrow(run, "chunk int, counts binary")


def _frequencies(described: DataFrame) -> np.ndarray:
    """The corpus table: CELLS counts, 4 MB whatever the corpus."""
    rows = described.where("chunk IS NOT NULL").select("chunk", "counts", F.floor(F.col("task") / 64).alias("lot"))
    first = _sum_tables(rows.repartition("chunk", "lot").select("chunk", "counts"))
    final = _sum_tables(first.repartition(CHUNKS, "chunk"))
    out = np.zeros(CELLS, np.uint32)
    width = CELLS // CHUNKS
    for row in final.collect():
        out[row["chunk"] * width : (row["chunk"] + 1) * width] = np.frombuffer(zlib.decompress(row["counts"]), "<u4")
    return out


def _least_overlap(size, percent: int):
    """ceil(percent / 100 * size): the tokens any partner shares at least."""
    return -(-percent * size // 100)


def _prefixes(docs: DataFrame, n: int, percent: int, frequency: np.ndarray) -> DataFrame:
    """(fp, n, tokens): each set's first tokens in the global order, for the longest multi-match."""
    sent = docs.sparkSession.sparkContext.broadcast(frequency)
    schema = pa.schema([("fp", pa.int64()), ("n", pa.int32()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts, seen = _Words(), sent.value, set()
        for batch in batches:
            prints, sizes, lists = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                tokens = shingles(text.as_py(), n, table)
                fp = fingerprint(tokens)
                if not len(tokens) or fp in seen:  # copies in this task add nothing
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(fp)
                least = _least_overlap(len(tokens), percent)
                length = len(tokens) - least + min(MOST, least)
                prints.append(fp)
                sizes.append(len(tokens))
                lists.append(first_tokens(tokens, counts, length).view(np.int64))
            if prints:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(lists), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), column], schema=schema)

    return texts(docs).mapInArrow(run, "fp long, n int, tokens array<long>")


def _choose(posts: DataFrame, percent: int) -> DataFrame:
    """(key, id, rank, need, size, most): the postings of each document's adaptive prefix.

    ``need`` is the document's l.  With s_l the length of the lists that its
    first |x| - c + l tokens have, l minimises s_l + VERIFY * s_l / l.  ``most``
    is the largest partner for which the token at ``rank`` may be among the
    first l that both share: linked sets share t / (1 + t) of |x| + |y|.
    """
    from pyspark.sql import Window

    own = Window.partitionBy("id")
    least = F.ceil(F.col("n") * percent / 100).cast("int")
    rows = posts.withColumn("least", least)
    sums = {l: F.sum(F.when(F.col("rank") < F.col("n") - F.col("least") + l, F.col("df") - 1).otherwise(0)).over(own) for l in range(1, MOST + 1)}
    rows = rows.withColumns({f"s{l}": s for l, s in sums.items()})
    costs = F.array(*(F.when(F.col("least") >= l, F.struct((F.col(f"s{l}") * (1 + VERIFY / l)).alias("cost"), F.lit(l).alias("l"))) for l in range(1, MOST + 1)))
    need = F.array_min(F.filter(costs, lambda x: x.isNotNull()))["l"]
    rows = rows.withColumn("need", need).where(F.col("rank") < F.col("n") - F.col("least") + F.col("need"))
    most = F.expr(f"(CAST(n AS BIGINT) + need - 1 - rank) * {100 + percent} div {percent} - n")
    return rows.select("key", "id", "rank", "need", F.col("n").alias("size"), most.cast("int").alias("most")).where("most * 100 >= size * " + str(percent))


def _sets(docs: DataFrame, sources: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(id, tokens): the sets of the wanted fingerprints, each from one of its documents."""
    keys = sources.join(wanted, sources["fp"] == wanted["id"], "left_semi")
    keys = few(settle(keys.select(F.col("doc_id").alias("__id")).distinct()))
    rows = texts(docs)
    rows = rows.join(keys, rows["doc_id"].eqNullSafe(keys["__id"]), "left_semi").select("text")

    def make():
        table = _Words()

        def work(rows):
            for (text,) in rows:
                tokens = shingles(text.encode("utf-8", "replace"), n, table)
                yield fingerprint(tokens), tokens.tobytes()

        return work

    found = map_rows(rows, make, "id long, tokens binary")
    return found.join(wanted, "id", "left_semi").dropDuplicates(["id"])


def _verifier(docs: DataFrame, named: DataFrame, n: int, percent: int):
    """Pairs (a, b) to those whose sets link.

    Sets are made from the texts when a pair first needs them, and kept in a
    checkpoint; only those that pairs need are shuffled.  Copies of a set meet
    in partial sums, before anything is joined by its name.
    """
    made: list[DataFrame] = []
    sources = settle(named.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id")))

    def make():
        def work(rows):
            for a, b, x, y in rows:
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    yield a, b

        return work

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = settle(pairs)
        ids = settle(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        new = ids
        for part in made:
            new = new.join(part.select("id"), "id", "left_anti")
        new = settle(new)
        if new.take(1):
            made.append(cut(_sets(docs, sources, new, n)))
        if not made:
            return pairs
        sets = reduce(DataFrame.unionAll, made).join(few(ids), "id", "left_semi").withColumn("size", F.length("tokens"))
        one = pairs.join(sets.toDF("a", "x", "sx"), "a")
        both = one.join(sets.toDF("b", "y", "sy"), "b").where(F.least("sx", "sy") * 100 >= F.greatest("sx", "sy") * percent)
        return map_rows(both.select("a", "b", "x", "y"), make, "a long, b long", step=256)

    return verify


def _labelled(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n, label) of each row; rows with equal labels and a set are linked."""
    described = cut(_describe(docs, n))
    named = described.where("chunk IS NULL").select("doc_id", "text_hash", "n", "fp")
    prefixes = _prefixes(docs, n, percent, _frequencies(described))
    prefixes = cut(prefixes)
    flat = prefixes.select(F.explode("tokens").alias("key"))
    # keys met once are dropped before the postings are shuffled
    lists = flat.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("key")
    at = F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.col("rank").cast("bigint")).alias("at")
    posts = prefixes.select("fp", "n", F.posexplode("tokens").alias("rank", "key")).select("key", F.col("fp").alias("id"), at)
    # several tasks may have seen the same set
    shared = cut(posts.join(lists, "key").distinct())
    lengths = shared.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = shared.join(lengths, "key")
    shared = shared.select("key", "id", "df", F.shiftright("at", 32).cast("int").alias("n"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("rank"))
    chosen = cut(_choose(shared, percent))
    several = chosen.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low != high").select("key")
    chosen = cut(chosen.join(several, "key", "left_semi"))
    labels = settle(link_groups(chosen, _verifier(docs, named, n, percent), matches=True))
    own = named.join(few(labels), named["fp"] == labels["id"], "left")
    return own.select("doc_id", "text_hash", "n", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``."""
    own = _labelled(docs, n, percent)
    full = own.where("n > 0")
    # only components of several rows are named by join, so a large one is not a hot key of all rows
    least = full.groupBy("label").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    linked = full.join(few(settle(least.select("label", "least"))), "label", "left")
    linked = linked.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
    alone = own.where("n = 0").select("doc_id", F.lit(0).cast("bigint").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone)


def keep_one(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """``docs`` with one row of each component: the one of smallest id.

    Ties in the id are broken by a hash of the text, and of rows that repeat
    id and text one stays; a row without an id stays only if none of its
    component has one.  A row is judged by its id and text, so rows that share
    an id but not their text don't go with each other.  Rows without words are
    linked with nothing and stay.
    """
    own = _labelled(docs, n, percent).where("n > 0")
    order = F.struct(F.col("doc_id").isNull().alias("__none"), "doc_id", "text_hash")
    first = own.groupBy("label").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    placed = own.join(few(settle(first.select("label", "first"))), "label")
    is_first = order.eqNullSafe(F.col("first"))
    gone = few(settle(placed.where(~is_first).select("doc_id", "text_hash").distinct())).toDF("__id", "__hash")
    again = settle(placed.where(is_first).groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    again = few(again.select("doc_id", "text_hash")).toDF("__id", "__hash")
    rows = docs.withColumn("__h", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))

    def same(other: DataFrame):
        return rows["doc_id"].cast("bigint").eqNullSafe(other["__id"]) & (rows["__h"] == other["__hash"])

    kept = rows.join(gone, same(gone), "left_anti")
    if again.take(1):
        once = kept.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "__h"])
        kept = kept.join(again, same(again), "left_anti").unionAll(once)
    return kept.drop("__h")
