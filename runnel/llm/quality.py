"""Quality classifier: a factorisation machine.

Features are hashed words (their share of the text), statistics of its
structure and length, and metadata: the stored character count and whether
there is one.  The score is

    w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2],

which takes time linear in the features.  Labels, languages, sources and ids
are never features.  The model is fitted in one task from a bounded sample of
labelled rows (``SAMPLE`` ids, each with one text); only its weights, which are
of fixed size, reach the driver.  Scoring covers every whole text.

Null and empty texts have no words, only statistics, and get a score like any
other; so do rows without a count.  Repeated rows repeat their score; of rows
that share a labelled id, the text of smallest hash is learned from.  Without
labelled rows every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, short_batches, texts

#: Most labelled rows that a model is fitted on.
SAMPLE = 8192
BUCKETS, RANK = 1 << 14, 8

_KIND = np.full(256, 0, np.uint8)  # other
for _chars, _k in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (" \t\r\x0b\x0c", 4), ("\n", 5), (".,;:?'\"()-", 6), ("|", 7), ("!", 8), ("#$%&*@^~+=<>{}[]\\/_`", 9)):
    for _c in _chars:
        _KIND[ord(_c)] = _k
_KIND[128:] = 10
N_KINDS = 11
N_STATS = N_KINDS + 11


class _Words(dict):
    """Word to bucket, in a table of bounded size."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        bucket = self[word] = crc32(word.encode("utf-8", "replace")) % BUCKETS
        return bucket


def features(text: str, n_chars: int | None, table: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, values, statistics) of one whole text and its stored count."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=N_KINDS) / max(1, len(raw))
    words = text.split()
    n = len(words)
    hashed = np.fromiter(map(table.__getitem__, words), np.int64, n)
    buckets, counts = np.unique(hashed, return_counts=True)
    lines = text.split("\n")
    marked = sum(w[-1] in "!#$%&*" for w in words) / n if n else 0.0
    more = [
        np.log1p(len(raw)) / 10,
        np.log1p(n) / 8,
        min(len(raw) / max(1, n), 40) / 10,
        len(buckets) / max(1, n),
        counts.max() / n if n else 0.0,
        1 - len(set(lines)) / len(lines),
        np.log1p(len(raw) / len(lines)) / 8,
        marked,
        np.log1p(max(n_chars or 0, 0)) / 10,
        float(n_chars is None),
        1.0,
    ]
    values = counts / np.sqrt(np.dot(counts, counts)) if n else np.zeros(0)
    return buckets, values, np.concatenate([kinds, more])


@dataclass
class FactorisationMachine:
    """Weights over BUCKETS hashed words and then N_STATS statistics."""

    w0: float
    w: np.ndarray
    v: np.ndarray

    @classmethod
    def empty(cls) -> "FactorisationMachine":
        return cls(0.0, np.zeros(BUCKETS + N_STATS), np.zeros((BUCKETS + N_STATS, RANK)))

    def margin(self, index: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[index] * x[:, None]
        s = vx.sum(0)
        return float(self.w0 + self.w[index] @ x + 0.5 * (s @ s - np.einsum("ij,ij->", vx, vx)))

    def score(self, text: str, n_chars: int | None, table: dict[str, int]) -> float:
        buckets, values, stats = features(text, n_chars, table)
        index = np.concatenate([buckets, np.arange(BUCKETS, BUCKETS + N_STATS)])
        z = min(max(self.margin(index, np.concatenate([values, stats])), -30.0), 30.0)
        return 1.0 / (1.0 + float(np.exp(-z)))


def fit(index: np.ndarray, x: np.ndarray, starts: np.ndarray, labels: np.ndarray, epochs: int = 8, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> FactorisationMachine:
    """AdaGrad on the logistic loss; classes weigh the same in total.

    Row i has the entries ``starts[i]`` to ``starts[i + 1]`` of ``index`` and ``x``.
    """
    model, n = FactorisationMachine.empty(), len(labels)
    if not n:
        return model
    rng = np.random.default_rng(seed)
    model.v = rng.normal(0, 0.01, model.v.shape)
    y = labels.astype(float)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    g0, gw, gv = 1e-8, np.full(model.w.shape, 1e-8), np.full(model.v.shape, 1e-8)
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 128):
            batch = order[at : at + 128]
            idx = np.concatenate([index[starts[i] : starts[i + 1]] for i in batch]).astype(np.int64)
            val = np.concatenate([x[starts[i] : starts[i + 1]] for i in batch]).astype(float)
            sizes = starts[batch + 1] - starts[batch]
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            own = np.repeat(np.arange(len(batch)), sizes)
            vx = model.v[idx] * val[:, None]
            s = np.add.reduceat(vx, begins)
            z = model.w0 + np.add.reduceat(model.w[idx] * val, begins) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), begins))
            delta = weight[batch] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch])
            d = delta[own] * val
            grad_v = d[:, None] * (s[own] - vx)
            hit, back = np.unique(idx, return_inverse=True)
            sum_w = np.bincount(back, d, len(hit)) / len(batch) + decay * model.w[hit]
            sum_v = np.stack([np.bincount(back, grad_v[:, f], len(hit)) for f in range(RANK)], 1) / len(batch) + decay * model.v[hit]
            gw[hit] += sum_w**2
            gv[hit] += sum_v**2
            model.w[hit] -= rate * 4 * sum_w / np.sqrt(gw[hit])
            model.v[hit] -= rate * sum_v / np.sqrt(gv[hit])
            step = delta.mean()
            g0 += step**2
            model.w0 -= rate * step / np.sqrt(g0)
    return model


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counts(docs: DataFrame):
    """The stored character count; null where the table has none."""
    return F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.lit(None).cast("bigint")


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_chars)."""
    return texts(docs.withColumn("__n", _counts(docs)), keep=["__n"]).withColumnRenamed("__n", "n_chars")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorisationMachine:
    """Fit on at most ``sample`` labelled ids, chosen by a hash of the id, with one text each.

    The ids have a fixed bound, so they are broadcast.  Their features, 8 bytes
    for each distinct word of a text and BUCKETS words at most, meet in the one
    task that fits; it gives 0.6 MB of weights.  Rows with a null id or label
    are left out.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
    chosen = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = _rows(docs).join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "n_chars", "y")).alias("r"))

    def make():
        table = _Words()

        def work(rows):
            for doc_id, text, n_chars, y in rows:
                buckets, values, stats = features(text, n_chars, table)
                index = np.concatenate([buckets, np.arange(BUCKETS, BUCKETS + N_STATS)])
                yield doc_id, index.astype("<i4").tobytes(), np.concatenate([values, stats]).astype("<f4").tobytes(), y

        return work

    found = map_rows(one.select("doc_id", "r.text", "r.n_chars", "r.y"), make, "doc_id long, places binary, vals binary, y int")

    def fit_all(batches):
        import pyarrow as pa

        held = []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        held.sort(key=lambda r: r[0])
        starts = np.concatenate([[0], np.cumsum([len(r[1]) // 4 for r in held])]).astype(np.int64)
        index = np.frombuffer(b"".join(r[1] for r in held), "<i4")
        x = np.frombuffer(b"".join(r[2] for r in held), "<f4")
        model = fit(index, x, starts, np.array([r[3] for r in held]))
        weights = [model.w.astype("<f4").tobytes(), model.v.astype("<f4").tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([model.w0]), pa.array(weights[:1]), pa.array(weights[1:])], names=["w0", "w", "v"])

    row = found.repartition(1).mapInArrow(fit_all, "w0 double, w binary, v binary").first()
    if row is None:
        return FactorisationMachine.empty()
    return FactorisationMachine(row["w0"], np.frombuffer(row["w"], "<f4").astype(float), np.frombuffer(row["v"], "<f4").astype(float).reshape(-1, RANK))


def _sent(docs: DataFrame, model: FactorisationMachine):
    """The model as a broadcast of 0.6 MB, and how a task opens it."""
    held = docs.sparkSession.sparkContext.broadcast((model.w0, model.w.astype(np.float32), model.v.astype(np.float32)))

    def open_() -> FactorisationMachine:
        w0, w, v = held.value
        return FactorisationMachine(w0, w.astype(float), v.astype(float))

    return open_


def score(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """(doc_id, score) for every row."""
    open_ = _sent(docs, model)

    def make():
        table, machine = _Words(), open_()
        return lambda rows: [(doc_id, machine.score(text, n_chars, table)) for doc_id, text, n_chars in rows]

    return map_rows(_rows(docs), make, "doc_id long, score double")


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (all their columns) whose text scores at least ``threshold``.

    The texts pass through the scorer as they are, so no join is needed and
    repeated or null ids do no harm.
    """
    open_ = _sent(docs, train(docs, labels))
    columns, at = docs.columns, docs.columns.index("text")
    counted = columns.index("n_chars") if "n_chars" in columns else None
    short_batches(docs)

    import pyarrow as pa

    def run(batches):
        table, machine = _Words(), open_()
        for batch in batches:
            counts = batch.column(counted).cast(pa.int64()).to_pylist() if counted is not None else [None] * batch.num_rows
            keep = [machine.score(t or "", n, table) >= threshold for t, n in zip(batch.column(at).to_pylist(), counts, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.select(*columns).mapInArrow(run, docs.schema)
