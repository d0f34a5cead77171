"""Joins, line classes, packing, search, classifier: against brute force and held-out rows."""

import random
from collections import defaultdict
from zlib import crc32

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from runnel.llm import ann, graph, line_dedup, near_join, packing, quality, registry

WORDS = [f"w{i}" for i in range(400)]


def copies(seed=4, n=160):
    """A hot group of near copies with few and many edits, exact copies, shared passages, short texts."""
    rng = random.Random(seed)
    base = [rng.choice(WORDS) for _ in range(120)]
    passage = [rng.choice(WORDS) for _ in range(60)]
    out = []
    for _ in range(n):
        words = base.copy()
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 5, 8, 12])):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        out.append(" ".join(words))
    for _ in range(n // 2):
        own = [rng.choice(WORDS) for _ in range(rng.randrange(5, 40))]
        out.append(" ".join(own + passage))
    for _ in range(n):
        out.append(" ".join(rng.choice(WORDS[:6]) for _ in range(rng.randrange(0, 7))))
    out += [None, "", "   \n", out[0].upper(), "One two", "one  two", "one two three four", "é É"]
    rng.shuffle(out)
    return out


def as_docs(spark, texts, parts=6):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_components_of_made_copies(spark, n, percent):
    texts = copies()
    rows = near_join.near_duplicates(as_docs(spark, texts), n, percent).collect()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows)
    assert got == sorted(brute.components(range(len(texts)), texts, n, percent))


def test_one_of_each_group_stays(spark):
    one, near = " ".join(WORDS[:60]), " ".join(WORDS[:59] + ["else"])
    rows = [(5, one, 1), (5, one, 2), (5, near, 3), (7, one, 4), (7, "a text of its own words", 5), (None, near, 6), (9, "", 7), (9, "", 8), (9, None, 9)]
    rows += [(None, "no id but these words", 10), (None, "no id but these words", 11), (3, "x y z", 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __none int").repartition(3)
    kept = near_join.keep_one(docs, 5, 80).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) in [
        sorted([(5, t), (7, rows[4][1]), (9, ""), (9, ""), (9, None), (None, rows[9][1]), (3, "x y z")], key=str) for t in (one, near)
    ]
    assert kept[0].asDict().keys() == {"doc_id", "text", "__none"}


def test_components_of_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    want = sorted(brute.components([r.doc_id for r in docs], [r.text for r in docs]))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in registry.op4_ngram_jaccard_join(spark, data).collect())
    assert got == want


def test_union_find(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    forest = brute.Forest()
    for a, b in edges:
        forest.join(a, b)
    got = {r.id: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: forest.find(x) for x in nodes}


def test_pivots_at_finer_keys(spark):
    """Strangers that share only a finer key with their group's pivot aren't paired with all of its component."""
    one, other, few = range(300), [*range(1, 300), *range(500, 531)], [0, *range(2000, 2015)]
    rows = [(key, i, min(i, 1), 1, 10, 12) for key, ids in enumerate((one, other, few)) for i in ids]
    posts = spark.createDataFrame(rows, "key long, id long, rank long, need int, size int, most int")
    asked = []

    def verify(pairs):  # all link with 0, but for a part of its line (500) and those at the last key
        pairs = pairs.localCheckpoint()
        asked.append(pairs.count())
        return pairs.where("a = 0 AND b < 2000 AND b != 500")

    def refine(ids):
        part = F.col("id") == 500
        size, most = F.when(part, 2).otherwise(10), F.when(part, 2).otherwise(12)
        rank = F.when(part, -1).when(F.col("id") == 0, 0).otherwise(1).cast("bigint")
        return ids.where("id < 2000").select("*", F.lit(9).cast("bigint").alias("key"), rank.alias("rank"), F.lit(1).alias("need"), size.alias("size"), most.alias("most"))

    got = {r.id: r.label for r in graph.link_groups(posts, verify, refine=refine).collect()}
    assert {i for i in got if got[i] == 0} == {*range(300), *range(501, 531)}
    assert max(asked) <= graph.PIVOTS * len(rows)


def line_set(line):
    """Shingles from the definition, by position: words, steps of 12 in longer words, every character of runs."""
    out, end = set(), 0
    for at, char in enumerate(line):
        if char in " \t\x0b\x0c\r":
            continue
        if at >= end:  # a word begins
            end = next((j for j in range(at, len(line)) if line[j] in " \t\x0b\x0c\r"), len(line))
            place = at
        if at == place:
            out.add(line[at : at + 12])
            place += 1 if end - at > 24 else 12
    return frozenset(out)


def test_line_classes(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 1000")
    rows = line_dedup.line_classes(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    label = {}
    for r in rows:
        line = texts[r.doc_id].split("\n")[r.pos].strip()
        assert label.setdefault(line, r.label) == r.label
    assert set(label) == {x.strip() for t in texts.values() for x in t.split("\n")} - {""}
    lines = sorted(label)
    sets = [line_set(x) for x in lines]
    near = brute.pairs_above(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    forest = brute.Forest()
    for i, j in near:
        forest.join(lines[i], lines[j])
    groups = defaultdict(set)
    for x in lines:
        groups[label[x]].add(forest.find(x))
    assert all(len(g) == 1 for g in groups.values())  # nothing is joined that isn't linked
    found = sum(label[lines[i]] == label[lines[j]] for i, j in near)
    assert found >= 0.98 * len(near)


def test_bands(spark):
    """The two nearest hashes on either side of two places, for lines of every size."""
    rng = random.Random(3)
    for size in (1, 2, 3, 5, 40):
        h = sorted(rng.randrange(-(2**63), 2**63) for _ in range(size))
        up = [x for x in h if x >= 0]
        down = [x for x in h if x < 0]
        want = [h[:2], h[-2:], (up + h)[:2], (h + down)[-2:]] if size > 1 else [h] * 4
        df = spark.createDataFrame([(h, want)], "h array<long>, w array<array<long>>")
        row = line_dedup.with_bands(df).select(*(F.col(f"b{i}") for i in range(4)), *(F.xxhash64(F.lit(i), F.col("w")[i]) for i in range(4))).first()
        assert row[:4] == row[4:], size


def test_deduped_lines(spark):
    line = " ".join(WORDS[:40])
    near = line.replace("w7 ", "w399 ")
    docs = spark.createDataFrame(
        [(3, f"{line}\nb one\n\n {line} ", 1), (1, near, 2), (2, "own line here\nb one", 3), (2, "own line here\nb one", 3), (9, None, 4), (None, "b one\nzz", 5), (8, "", 6)],
        "doc_id long, text string, label int",
    )
    out = line_dedup.dedup_lines(docs)
    rows = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped, r.label) for r in out.collect()), key=repr)
    # a null id sorts first, so it keeps "b one"; both rows of the repeated document get the same result
    assert rows == sorted([(3, "", 4, 3, 1), (1, near, 1, 0, 2), (2, "own line here", 2, 1, 3), (2, "own line here", 2, 1, 3), (9, None, 0, 0, 4), (None, "b one\nzz", 2, 0, 5), (8, "", 1, 0, 6)], key=repr)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_words_count_whole(spark):
    run = "".join(chr(0x4E00 + 7 * i % 997) for i in range(120))
    lines = ["https://example.com/reports/2021/annual", "https://example.org/totally/other", "https://example.com/reports/2021/annual/a", run, "x" + run[1:], run[:12] + run[60:]]
    lines += ["internationalisation_v1 foo", "internationalisation_v2 foo", "1234567890123456 paid", "1234567890129999 paid"]
    lines += ["https://example.com/products/red-shoes-41", "https://example.com/account/privacy", "ab\u2028cdefg", "ab\u2028other", "unquestionable", "unquestionably", "unquestionable 1 2", "z" * 24, "z" * 25, f"{'y' * 24} b", f"{'😀' * 20}{run[:9]}"]
    lines += [f"see https://example.com/{'q' * 20}/{i * 7919:09d}/{i * 104729:09d} now" for i in range(40)]
    docs = as_docs(spark, lines)
    hashes = docs.select("text", line_dedup.shingles(F.col("text")).alias("h")).collect()
    made = spark.createDataFrame([(x, sorted(line_set(x))) for x in lines], "text string, s array<string>")
    want = made.select("text", F.sort_array(F.transform("s", lambda s: F.xxhash64(s))).alias("h")).collect()
    assert {r.text: r.h for r in hashes} == {r.text: r.h for r in want}
    forest, sets = brute.Forest(), [line_set(x) for x in lines]
    for i, j in brute.pairs_above(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b)):
        forest.join(i, j)
    want = {i for i in range(len(lines)) if forest.find(i) != i}
    assert {2, 4} <= want and not want & {1, *range(5, 12), 13}
    rows = line_dedup.dedup_lines(docs).collect()
    assert {r.doc_id for r in rows if r.n_dropped} == want


# -- packing ------------------------------------------------------------
def test_packing(spark, data):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    extra = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "<|endoftext|> it's I'LL\x1c ẞ İ\x85z ́a"), (10**6 + 3, "word " * 9000)]
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionAll(spark.createDataFrame(extra, "doc_id long, text string"))
    want = {r.doc_id: [*own.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    rows = packing.pack(docs, path).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == crc32(np.array(ids, "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, ids in want.items():
        at = 0
        for start, length in sorted(pieces[doc_id]):
            assert start == at
            at += length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(map(len, want.values())) / (2048 * len(sequences)) > 0.95


def test_histogram_patterns():
    rng = random.Random(0)
    for _ in range(30):
        counts = {rng.randrange(1, 33): rng.randrange(1, 50) for _ in range(rng.randrange(0, 20))}
        patterns = packing.pack_histogram(counts, 32)
        got = defaultdict(int)
        for n, pattern in patterns:
            assert sum(pattern) <= 32
            for length in pattern:
                got[length] += n
        assert got == counts


# -- search -------------------------------------------------------------
def exact(x, ids, q, name, k):
    score = x @ q
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != name][:k]
    return [(int(ids[i]), float(score[i])) for i in order]


def test_recall(spark, data):
    vectors = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = vectors.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float32).astype(float)
    got = defaultdict(dict)
    for r in registry.op5_nearest_neighbours(spark, data).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    hit = total = 0
    for i, name in enumerate(ids.tolist()):
        if name % 20:
            continue
        want = exact(x, ids, x[i], name, 20)
        mine = [got[name][k + 1] for k in range(len(got[name]))]
        assert len(mine) == len(want) and all(abs(s - x[np.where(ids == v)[0][0]] @ x[i]) < 1e-12 for v, s in mine)
        assert mine == sorted(mine, key=lambda p: (-p[1], p[0]))
        hit += len({v for v, _ in mine} & {v for v, _ in want})
        total += len(want)
    assert hit / total >= 0.9


def test_search_at_a_tight_shortlist(spark):
    """Recall when far fewer than all vectors of a block are ranked exactly."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    x = (centres[rng.integers(0, 40, 4000)] + 0.7 * rng.normal(size=(4000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    hit = total = 0
    got = defaultdict(set)
    for r in ann.search(df, df.where("vec_id % 40 = 0"), k=10).collect():
        got[r.query_id].add(r.vec_id)
    for name in got:
        want = exact(x.astype(float), np.arange(4000), x[name].astype(float), name, 10)
        hit, total = hit + len(got[name] & {v for v, _ in want}), total + 10
    assert len(got) == 100 and hit / total >= 0.9


@pytest.mark.parametrize("noise", [0.0, 0.02])
def test_search_near_large_groups(spark, noise):
    """More copies, or near copies, lie nearest than a shortlist holds."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    copied = rng.permutation(6000)[:2000]
    x[copied] = 3 * x[copied[0]] + noise * rng.normal(size=(2000, 32)).astype(np.float32)
    asked = [int(v) for v in copied[:10]]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in sorted(ann.search(df, df.where(F.col("vec_id").isin(asked)), k=20, shortlist=16).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append(r.vec_id)
    hit = 0
    for name in asked:
        want = [v for v, _ in exact(x.astype(float), np.arange(6000), x[name].astype(float), name, 20)] if noise else sorted(set(copied.tolist()) - {name})[:20]
        assert len(got[name]) == 20 and (noise or got[name] == want)
        hit += len(set(got[name]) & set(want))
    assert hit >= 0.9 * 20 * len(asked)


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (None, [1.0, 1.0]), (40, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, df.where("vec_id = 0"), k=20).collect()]
    assert sorted(got) == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 0.0), (0, 4, 20, 0.0)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    assert ann.search(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0


# -- classifier ---------------------------------------------------------
def test_held_out_accuracy(spark, data):
    out = registry.op6_quality_classifier(spark, data)
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "quality")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    for r in out.collect():
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_linear_time_identity():
    rng = np.random.default_rng(0)
    m = quality.FactorisationMachine(0.3, rng.normal(size=30), rng.normal(size=(30, 4)))
    index, x = np.array([1, 5, 9, 20]), rng.normal(size=4)
    direct = m.w0 + m.w[index] @ x
    for i in range(4):
        for j in range(i + 1, 4):
            direct += (m.v[index[i]] @ m.v[index[j]]) * x[i] * x[j]
    assert m.margin(index, x) == pytest.approx(direct)


def test_classifier_without_labels(spark):
    docs = spark.createDataFrame([(1, None), (None, "x"), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert [r.score for r in quality.score(docs, model).collect()] == [0.5] * 3
    assert quality.filter_quality(docs, labels).count() == 3
    assert docs.select(quality.held_out().alias("h")).where(F.col("h").isNull()).count() == 0
