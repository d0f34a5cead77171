"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of full-dimensional codewords, one from each
codebook.  The books are fitted residual by residual on a bounded sample and
refined by least squares; every vector is encoded by a beam search and stored
as its codes and norm.  A query makes one table of inner products for each
book, so scoring a vector adds up as many entries as there are books.  The best
of every block are ranked again by exact inner products in double precision, and
with them all whose approximate score comes within SIGMAS standard errors of the
k-th exact one, however many.  Equal vectors of a block are one candidate that
stands for all their ids.

Vectors that are null, all zero, empty, or hold null or non-finite components
take no part, nor do those whose dimension isn't the table's most common one
(the smaller of equals).  Rows that repeat an id are separate candidates, and a
query's candidates are all rows with another id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_rows

#: Codebooks, codewords in each, beam width, most vectors that books are fitted on.
BOOKS, WORDS, BEAM, SAMPLE = 8, 256, 8, 16_384
#: Vectors and queries in a block; candidates of a block that are ranked exactly.
BLOCK, QUERIES, SHORTLIST = 8192, 2048, 128
#: A score's standard error is that of a remainder in a random direction.
SIGMAS = 3.0


@dataclass
class Codebooks:
    books: np.ndarray  # (books, words, dim) float32

    def __post_init__(self) -> None:
        flat = self.books.reshape(-1, self.books.shape[2])
        self.gram = flat @ flat.T

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (n, books) uint8 that a beam search finds for small ||x - sum||."""
        m, k, _ = self.books.shape
        n = len(x)
        dots = x @ self.books.reshape(m * k, -1).T
        codes = np.zeros((n, 1, 0), np.int64)
        error = np.zeros((n, 1))  # ||sum||^2 - 2 <x, sum>
        for j in range(m):
            own = slice(j * k, (j + 1) * k)
            add = np.diagonal(self.gram)[own][None, :] - 2 * dots[:, own]
            total = error[:, :, None] + add[:, None, :]
            for i in range(j):
                total += 2 * self.gram[codes[:, :, i] + i * k, own]
            flat = total.reshape(n, -1)
            width = min(beam, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width] if width < flat.shape[1] else np.tile(np.arange(width), (n, 1))
            error = np.take_along_axis(flat, best, 1)
            codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], 1), (best % k)[:, :, None]], 2)
        top = error.argmin(1)
        return codes[np.arange(n), top].astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[j][codes[:, j]] for j in range(len(self.books)))

    def table(self, queries: np.ndarray) -> np.ndarray:
        """(books, words, queries) of inner products."""
        return np.einsum("mkd,qd->mkq", self.books, queries, optimize=True).astype(np.float32)


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, passes: int = 2, seed: int = 5) -> Codebooks:
    """Residual k-means, then alternate beam encoding and least squares."""
    rng = np.random.default_rng(seed)
    words = min(words, max(1, len(x)))
    residual, found = x.astype(np.float32).copy(), []
    for _ in range(books):
        centres = residual[rng.choice(len(x), words, replace=len(x) < words)].copy()
        for _ in range(5):
            near = (np.einsum("kd,kd->k", centres, centres)[None] - 2 * residual @ centres.T).argmin(1)
            counts = np.bincount(near, minlength=words)
            sums = np.stack([np.bincount(near, residual[:, d], words) for d in range(x.shape[1])], 1)
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres).astype(np.float32)
        near = (np.einsum("kd,kd->k", centres, centres)[None] - 2 * residual @ centres.T).argmin(1)
        residual -= centres[near]
        found.append(centres)
    out = Codebooks(np.stack(found))
    for _ in range(passes):
        codes = np.concatenate([out.encode(x[at : at + 2048].astype(np.float32), 2) for at in range(0, len(x), 2048)]).astype(np.int64)
        places = (codes + np.arange(books) * words).ravel()
        own = np.repeat(np.arange(len(x)), books)
        # normal equations of the indicator matrix, with a little ridge
        size = books * words
        cross = np.zeros((size, size), np.float32)
        for i in range(books):
            for j in range(books):
                np.add.at(cross, (codes[:, i] + i * words, codes[:, j] + j * words), 1)
        right = np.zeros((size, x.shape[1]))
        np.add.at(right, places, x[own])
        cross[np.diag_indices(size)] += 0.1
        # ridge towards the present books keeps unused words
        right += 0.1 * out.books.reshape(size, -1)
        out = Codebooks(np.linalg.solve(cross.astype(float), right).reshape(out.books.shape).astype(np.float32))
    return out


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, as array<float>."""
    v = F.col(vector_col)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.cast("array<float>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1)
    dim = common.first()
    return rows.where(F.size("v") == (dim["dim"] if dim else 0))


def _blocks(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """(block, ids, data): the rows in ``blocks`` about equal lots, each in pieces of one task's share."""
    schema = pa.schema([("block", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])

    def run(batches):
        held: dict[int, list] = {}
        count = 0

        def flush():
            for block, parts in held.items():
                ids, data = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([ids.tobytes()]), pa.array([data.tobytes()])], schema=schema)
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            data = batch.column(1).flatten().to_numpy().reshape(len(ids), -1).astype(np.float32)
            lots = batch.column(2).to_numpy()
            for block in np.unique(lots).tolist():
                own = lots == block
                held.setdefault(block, []).append((ids[own], data[own]))
            count += len(ids)
            if count >= BLOCK:
                yield from flush()
                count = 0
        yield from flush()

    dealt = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit(name)), F.lit(blocks)).cast("int").alias("block"))
    return dealt.repartition("block").mapInArrow(run, "block int, ids binary, data binary")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shortlist: int = SHORTLIST) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by inner product.

    Queries meet candidates block by block: every pair of a query block and a
    vector block is one row, and leaves at most k rows for each query.
    """
    base = cut(usable(vectors, id_col, vector_col))
    total = base.count()
    dim = len(base.first()["v"]) if total else 1
    asked = usable(queries, id_col, vector_col).where(F.size("v") == dim)
    asked_n = asked.count()
    out_schema = "query_id long, rank int, vec_id long, score double"
    if not total or not asked_n:
        return vectors.sparkSession.createDataFrame([], out_schema)
    sample = base.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("v").toArrow()
    x = sample.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
    books = vectors.sparkSession.sparkContext.broadcast(fit(x, words=min(WORDS, max(1, len(x) // 4))).books)
    n_blocks, n_lots = -(-total // BLOCK), -(-asked_n // QUERIES)

    def encoder():
        own = Codebooks(books.value)

        def work(rows):
            for block, ids, data in rows:
                v = np.frombuffer(data, np.float32).reshape(-1, dim)
                codes = np.concatenate([own.encode(v[at : at + 512]) for at in range(0, len(v), 512)])
                norms = np.sqrt(np.einsum("nd,nd->n", v, v, dtype=float)).astype(np.float32)
                yield block, ids, data, codes.tobytes(), norms.tobytes()

        return work

    index = cut(map_rows(_blocks(base, n_blocks, "v"), encoder, "block int, ids binary, data binary, codes binary, norms binary", step=1))
    lots = _blocks(asked, n_lots, "q").toDF("lot", "query_ids", "query_data")

    def scorer():
        own = Codebooks(books.value)

        def work(rows):
            for ids, data, codes, norms, qids, qdata in rows:
                ids, v = np.frombuffer(ids, np.int64), np.frombuffer(data, np.float32).reshape(-1, dim)
                codes = np.frombuffer(codes, np.uint8).reshape(len(ids), -1).astype(np.int64)
                qids, q = np.frombuffer(qids, np.int64), np.frombuffer(qdata, np.float32).reshape(-1, dim)
                # equal vectors are one candidate; its ids are members[start[g] : start[g + 1]], in order
                rows_as = np.ascontiguousarray(v + np.float32(0)).view(np.dtype((np.void, 4 * dim))).ravel()
                _, first, group = np.unique(rows_as, return_index=True, return_inverse=True)
                order = np.lexsort((ids, group))
                members, start = ids[order], np.searchsorted(group[order], np.arange(len(first) + 1))
                low, high, single = members[start[:-1]], members[start[1:] - 1], np.diff(start) == 1
                v, codes, norms = v[first], codes[first], np.frombuffer(norms, np.float32)[first]
                # stored norms bring the approximation back to the vector's length
                guess = own.decode(codes)
                length = np.sqrt(np.einsum("nd,nd->n", guess, guess))
                scale = norms / np.maximum(length, 1e-12)
                rest = np.linalg.norm(v - scale[:, None] * guess, axis=1)
                exact = v.astype(float)
                for at in range(0, len(qids), 128):
                    part, names = q[at : at + 128], qids[at : at + 128]
                    table = own.table(part)
                    approx = np.zeros((len(first), len(part)), np.float32)
                    for j in range(codes.shape[1]):
                        approx += table[j][codes[:, j]]
                    approx *= scale[:, None]
                    approx[(low[:, None] == names[None, :]) & (high[:, None] == names[None, :])] = -np.inf
                    width = min(len(first), max(shortlist, k + 1))
                    near = np.argpartition(-approx, width - 1, axis=0)[:width] if width < len(first) else np.tile(np.arange(len(first))[:, None], (1, len(part)))
                    for c, name in enumerate(names.tolist()):
                        rough, p = approx[:, c], part[c].astype(float)
                        # sums row by row: equal vectors of different blocks get equal scores
                        picked = near[:, c][rough[near[:, c]] > -np.inf]
                        score = (exact[picked] * p).sum(1)
                        if width < len(first):
                            error = SIGMAS * np.linalg.norm(p) / np.sqrt(dim) * rest
                            more = rough + error >= np.partition(score, -k)[-k]
                            more[picked] = False
                            more = np.flatnonzero(more)
                            picked, score = np.concatenate([picked, more]), np.concatenate([score, (exact[more] * p).sum(1)])
                        if len(picked) > k:
                            best = score >= np.partition(score, -k)[-k]
                            picked, score = picked[best], score[best]
                        alone = single[picked]
                        found, scores = [low[picked[alone]]], [score[alone]]
                        for g, value in zip(picked[~alone].tolist(), score[~alone].tolist(), strict=True):
                            same = members[start[g] : start[g + 1]]
                            found.append(same[same != name][:k])
                            scores.append(np.full(len(found[-1]), value))
                        found, scores = np.concatenate(found), np.concatenate(scores)
                        for r in np.lexsort((found, -scores))[:k].tolist():
                            yield name, int(found[r]), float(scores[r])

        return work

    # block numbers only are crossed: as many as the vectors and queries have blocks
    met = index.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(n_lots - 1)))).join(lots, "lot")
    rows = met.select("ids", "data", "codes", "norms", "query_ids", "query_data")
    found = map_rows(rows.repartition(max(2, min(n_blocks * n_lots, 10_000))), scorer, "query_id long, vec_id long, score double", step=1)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
