"""Fuzzy line deduplication by MinHash, with built-in functions only.

A line is the set of its character shingles: SHINGLE characters (fewer at the
line's end) from the start of each word, and from every SHINGLE-th character of
a longer one.  A run of more than RUN characters without white space (an
address, a line of an unspaced script) has a shingle at every character while
more than RUN are left.  So every character counts.  Two lines are duplicates
at Jaccard similarity PERCENT / 100 or more of these sets.

Signature: the shingles' hashes are sorted on the circle of 64-bit values, and
the two nearest on either side of each of two opposite places are a band: the
minima and maxima of two rotations, BANDS in all.  Two lines agree on a band
with about similarity ** 2.  At 0.8 some band agrees in 98.3 of 100 cases, at
0.9 in 99.87.  Candidates are verified by exact Jaccard similarity, and components
of duplicates found by distributed union-find keep one line: the first by
document id and position.  What pivots leave of a large bucket is compared by
the rare shingles that duplicates must share, with pivots first, not pair by
pair.

Lines are compared without the white space at their ends.  Blank lines are
neither compared nor removed.  Null texts are empty.  Rows that repeat both id
and text are one document and get the same result each.  Lines are named by
64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, few, settle
from .graph import link_groups

SHINGLE, PERCENT, BANDS = 12, 80, 4
#: Longest word that is read in steps; longer ones are runs.
RUN = 2 * SHINGLE
#: What is trimmed from a line's ends.
BLANK = " \t\r\x0b\x0c"
#: A shingle is read ahead; then a short word, a character of a run, or a step of a longer word is passed over.
_READ = rf"(?s)(?=(.{{1,{SHINGLE}}}))(?:\S{{1,{SHINGLE}}}+(?!\S)\s*+|\S(?=\S{{{RUN}}})|\S{{1,{SHINGLE}}}+\s*+)"


def shingles(line: Column) -> Column:
    """Sorted distinct hashes of a line's shingles."""
    found = F.regexp_extract_all(line, F.lit(_READ), F.lit(1))
    return F.sort_array(F.array_distinct(F.transform(found, lambda s: F.xxhash64(s))))


def with_bands(df: DataFrame) -> DataFrame:
    """``df`` with columns b0, b1, ...: a hash for each band of the sorted array ``h``, wrapping round the circle."""
    h, n = F.col("h"), F.size("h")
    df = df.withColumn("__up", F.filter(h, lambda x: x >= 0)).withColumn("__last", F.slice(h, F.greatest(n - 1, F.lit(1)), F.lit(2)))
    upwards = F.slice(F.concat(F.slice("__up", 1, 2), h), 1, 2)
    downwards = F.slice(F.concat("__last", h), n - F.size("__up") + 1, F.lit(2))
    # a single shingle is all of a line
    each = [F.xxhash64(F.lit(i), F.when(n < 2, h).otherwise(side)) for i, side in enumerate((F.slice(h, 1, 2), F.col("__last"), upwards, downwards))]
    return df.withColumns({f"b{i}": band for i, band in enumerate(each)}).drop("__up", "__last")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, pos, line) of all lines that aren't blank."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    flat = rows.select("doc_id", F.xxhash64("__text").alias("text_hash"), F.posexplode(F.split("__text", "\n")).alias("pos", "line"))
    return flat.withColumn("line", F.btrim("line", F.lit(BLANK))).where("line != ''")


def _read(docs: DataFrame, places: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, h): the shingles of the wanted lines, each read at one place; other documents' lines aren't split."""
    at = places.join(few(wanted), "line_id", "left_semi").groupBy("line_id").agg(F.min(F.struct("doc_id", "text_hash", "pos")).alias("at"))
    at = settle(at.select("line_id", "at.*"))
    owners = few(settle(at.select(F.col("doc_id").alias("__id")).distinct()))
    held = docs.join(owners, docs["doc_id"].cast("bigint").eqNullSafe(owners["__id"]), "left_semi")
    rows = _lines(held).withColumn("line_id", F.xxhash64("line"))
    same = rows["doc_id"].eqNullSafe(at["doc_id"]) & (rows["text_hash"] == at["text_hash"]) & (rows["pos"] == at["pos"]) & (rows["line_id"] == at["line_id"])
    found = cut(rows.join(few(at), same, "left_semi").select(F.col("line_id").alias("id"), shingles(F.col("line")).alias("h")))
    # a place is one row unless documents repeat
    return found if found.count() == at.count() else cut(found.dropDuplicates(["id"]))


def line_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, pos, line_id, label) of every line that isn't blank; equal labels are duplicates."""
    lines = _lines(docs)
    signed = with_bands(lines.select("doc_id", "text_hash", "pos", F.xxhash64("line").alias("line_id"), shingles(F.col("line")).alias("h")))
    # columns of their own are narrower in a checkpoint than an array
    names = [f"b{i}" for i in range(BANDS)]
    signed = cut(signed.select("doc_id", "text_hash", "pos", "line_id", F.size("h").alias("size"), *names))
    places = signed.select("doc_id", "text_hash", "pos", "line_id")
    flat = signed.select(F.col("line_id").alias("id"), "size", F.explode(F.array(*names)).alias("key"))
    # keys that two different lines have; a line's copies meet in the partial sums
    shared = flat.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low != high").select("key")
    posts = settle(flat.join(few(settle(shared)), "key", "left_semi").distinct())
    hashed = _read(docs, places, settle(posts.select(F.col("id").alias("line_id")).distinct()))

    def verify(pairs: DataFrame) -> DataFrame:
        x, y = F.size("x"), F.size("y")
        both = pairs.join(hashed.toDF("a", "x"), "a").join(hashed.toDF("b", "y"), "b")
        both = both.withColumn("shared", F.size(F.array_intersect("x", "y")))
        return both.where(100 * F.col("shared") >= PERCENT * (x + y - F.col("shared"))).select("a", "b")

    def refine(ids: DataFrame) -> DataFrame:
        """Prefix postings of lines: the rarest shingles, at most as many as duplicates can differ in."""
        flat = settle(ids.join(hashed, "id").select("id", F.size("h").alias("size"), F.explode("h").alias("key")))
        counts = flat.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
        own = Window.partitionBy("id")
        ranked = flat.join(counts, "key").withColumn("place", F.row_number().over(own.orderBy("df", "key")) - 1)
        most = F.expr(f"(size - place) * {100 + PERCENT} div {PERCENT} - size").cast("int")
        prefix = ranked.withColumn("most", most).where(f"most * 100 >= size * {PERCENT}")
        # a pivot is a line whose rarest shingles are common: an edit brings rare ones
        prefix = prefix.withColumn("rank", F.floor(-1000 * F.avg(F.ln("df")).over(own)))
        return settle(prefix.where("df > 1").select("key", "id", "rank", F.lit(1).alias("need"), "size", "most"))

    # a group's pivot is the line that meets most others: of copies with edits, the one without
    crowd = posts.join(posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").groupBy("id").agg((-F.sum("n")).alias("rank"))
    largest = F.expr(f"CAST(size * 100 div {PERCENT} AS INT)").alias("most")
    posts = posts.join(crowd, "id").select("key", "id", "rank", F.lit(1).alias("need"), "size", largest)
    labels = settle(link_groups(settle(posts), verify, refine=refine))
    named = places.join(few(labels.toDF("line_id", "label")), "line_id", "left")
    return named.withColumn("label", F.coalesce("label", "line_id"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, gone): the positions of the lines that go from each document."""
    classes = line_classes(docs)  # read twice: a broadcast join with a checkpoint of lines
    # a class of one line has nothing to drop
    first = classes.groupBy("label").agg(F.min(F.struct("doc_id", "text_hash", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    placed = classes.join(few(settle(first.select("label", "first"))), "label")
    here = F.struct("doc_id", "text_hash", "pos")
    return placed.where(~here.eqNullSafe(F.col("first"))).groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, with ``text`` without its dropped lines, plus ``n_lines`` and ``n_dropped``.

    A null text stays null.  Existing columns of those two names are replaced.
    """
    gone = few(settle(dropped_lines(docs))).toDF("__id", "__hash", "__gone")
    rows = docs.withColumn("__h", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    same = rows["doc_id"].cast("bigint").eqNullSafe(gone["__id"]) & (rows["__h"] == gone["__hash"])
    wide = rows.join(gone, same, "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__gone", i))
    ends = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    out = wide.withColumn("n_lines", F.coalesce(ends + 1, F.lit(0)).cast("bigint"))
    out = out.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    out = out.withColumn("n_dropped", F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint"))
    return out.drop("__id", "__hash", "__gone", "__h")
