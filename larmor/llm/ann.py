"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one word from each of several full-dimensional codebooks.  The codebooks are
trained stage by stage on the residuals of a bounded sample; every row is encoded by beam search and
stored with the norm of its approximation.  Rows lie in shards of bounded size, queries in blocks; each
block meets each shard once.  There the inner products of a query with all code words make a lookup
table, a row's approximate score is a sum of table entries, and the best rows are scored again exactly
on their original vectors.  Equal vectors of a shard are encoded once and expanded by id, so copies
neither crowd the candidates nor break ties wrongly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CODEBOOKS = 16
WORDS = 256
BEAM = 4
SAMPLE = 8192
SHARD_ROWS = 16384
QUERY_ROWS = 1024
CANDIDATES = 400


def usable(vector: Column, dim: int | None = None) -> Column:
    """Neither null nor zero, and without null or non-finite components; of ``dim`` components if given."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    good = vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)
    return good if dim is None else good & (F.size(vector) == dim)


@dataclass
class Quantizer:
    """Codebooks as an array (stage, word, component)."""

    books: np.ndarray

    @staticmethod
    def train(sample: np.ndarray, stages: int = CODEBOOKS, words: int = WORDS, rounds: int = 5, seed: int = 7) -> Quantizer:
        """Residual codebooks: k-means on what the stages before leave."""
        rng = np.random.default_rng(seed)
        rest, books = sample.astype(np.float32).copy(), []
        for _ in range(stages):
            k = min(words, len(rest))
            book = rest[rng.choice(len(rest), k, replace=False)].copy()
            for _ in range(rounds):
                near = _nearest(rest, book)
                sums, n = np.zeros_like(book), np.bincount(near, minlength=k)
                np.add.at(sums, near, rest)
                book[n > 0] = sums[n > 0] / n[n > 0, None]
            rest -= book[_nearest(rest, book)]
            books.append(np.concatenate([book, np.repeat(book[:1], words - k, 0)]))
        return Quantizer(np.stack(books))

    def encode(self, x: np.ndarray, beam: int = BEAM, rows: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Codes (row, stage) and squared norms of the sums, by beam search over the stages."""
        codes, norms = [], []
        for at in range(0, len(x), rows):
            c, n = self._encode(x[at : at + rows].astype(np.float32), beam)
            codes.append(c)
            norms.append(n)
        stages = len(self.books)
        return (np.concatenate(codes), np.concatenate(norms)) if codes else (np.zeros((0, stages), np.uint8), np.zeros(0, np.float32))

    def _encode(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, every = len(x), np.arange(len(x))[:, None]
        rest, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
        for book in self.books:
            error = (rest**2).sum(-1)[..., None] - 2 * rest @ book.T + (book**2).sum(-1)
            width = min(beam, error.shape[1] * error.shape[2])
            flat = error.reshape(n, -1)
            best = np.argpartition(flat, width - 1, 1)[:, :width]
            path, word = best // len(book), best % len(book)
            rest = rest[every, path] - book[word]
            codes = np.concatenate([codes[every, path], word[..., None].astype(np.uint8)], 2)
        final = (rest**2).sum(-1).argmin(1)
        chosen = np.arange(n)
        return codes[chosen, final], ((x - rest[chosen, final]) ** 2).sum(-1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products (query, stage, word)."""
        return np.einsum("qd,swd->qsw", queries.astype(np.float32), self.books, optimize=True)


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    half = (book**2).sum(1) / 2
    return np.concatenate([(half - x[i : i + 4096] @ book.T).argmin(1) for i in range(0, len(x), 4096)])


class Shard:
    """Distinct vectors in codes, and for each its ids in ascending order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, norms: np.ndarray, firsts: np.ndarray) -> None:
        self.ids, self.vectors, self.codes, self.norms, self.firsts = ids, vectors, codes, norms, firsts

    def search(self, quantizer: Quantizer, query_ids: np.ndarray, queries: np.ndarray, k: int, candidates: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, exact score) of the best ``k`` rows for each query, its own id left out."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        lasts = np.append(self.firsts[1:], len(self.ids))
        for at in range(0, len(queries), 32):
            q = queries[at : at + 32]
            tables = quantizer.tables(q)
            scores = np.zeros((len(q), len(self.codes)), np.float32)
            for stage in range(tables.shape[1]):
                scores += tables[:, stage][:, self.codes[:, stage]]
            if metric == "l2":
                scores = 2 * scores - self.norms
            for one, query, approx in zip(query_ids[at : at + 32], q.astype(np.float64), scores, strict=True):
                near = np.arange(len(approx)) if len(approx) <= candidates else np.argpartition(approx, len(approx) - candidates)[-candidates:]
                x = self.vectors[near].astype(np.float64)
                exact = (x * query).sum(1) if metric == "ip" else -((x - query) ** 2).sum(1)
                # Of equal vectors the first k + 1 ids can be among the answers.
                wide = np.minimum(lasts[near] - self.firsts[near], k + 1)
                pos = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide - self.firsts[near], wide)
                ids, exact = self.ids[pos], np.repeat(exact, wide)
                other = ids != one
                ids, exact = ids[other], exact[other]
                best = np.lexsort((ids, -exact))[:k]
                found.append((np.full(len(best), one), ids[best], exact[best]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


@dataclass
class Index:
    """Stored shards with their quantizer; ``source`` holds the usable rows."""

    shards: DataFrame
    quantizer: Quantizer
    dim: int
    source: DataFrame
    count: int


def build(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, codebooks: int = CODEBOOKS, shard_rows: int = SHARD_ROWS) -> Index | None:
    """Index over every usable row; codebooks are fitted on ``sample`` rows, those with the smallest id hashes.

    Vectors that are null or zero, hold null or non-finite components, or have another length than most
    take no part.  Repeated rows (same id and vector) count once.  None when no row can take part.
    """
    named = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = named.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return None
    dim, n = sizes[0]["dim"], sizes[0]["count"]
    source = named.where(F.size("v") == dim)
    taken = source.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    quantizer = Quantizer.train(_matrix(taken.column("v"), dim), codebooks)
    shards = max(1, -(-n // shard_rows))
    sent = rows.sparkSession.sparkContext.broadcast(quantizer)

    def pack(table: pa.Table) -> pa.Table:
        ids, x = table.column("vec_id").to_numpy(), _matrix(table.column("v"), dim)
        order = np.lexsort((*x.T, ids))
        ids, x = ids[order], x[order]
        keep = np.append(True, (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(1))
        ids, x = ids[keep], np.ascontiguousarray(x[keep])
        order = np.lexsort((ids, *x.T))
        ids, x = ids[order], x[order]
        firsts = np.flatnonzero(np.append(True, (x[1:] != x[:-1]).any(1)))
        codes, norms = sent.value.encode(x[firsts])
        blobs = [ids.astype("<i8"), x[firsts].astype("<f4"), codes, norms.astype("<f4"), firsts.astype("<i8")]
        return pa.table({"shard": table.column("shard")[:1].cast(pa.int32()), **{k: pa.array([b.tobytes()], pa.binary()) for k, b in zip(("ids", "vectors", "codes", "norms", "firsts"), blobs, strict=True)}})

    dealt = source.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    packed = dealt.groupBy("shard").applyInArrow(pack, "shard int, ids binary, vectors binary, codes binary, norms binary, firsts binary")
    return Index(materialize(packed, "aq-shards"), quantizer, dim, source, n)


def search(index: Index, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, candidates: int = CANDIDATES, metric: str = "ip", query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found, nearest first, ties to the smaller id.

    ``metric`` is ``ip`` (largest inner product) or ``l2`` (score: minus the squared distance).  Scores
    are exact, in double precision.  A query does not find its own id; all rows come if there are fewer.
    Unusable queries give no rows; an id asked with several vectors is asked with the smallest of them.
    """
    dim, quantizer = index.dim, index.quantizer
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<float>").alias("q"))
    asked = asked.where(F.col("query_id").isNotNull() & usable(F.col("q"), dim)).groupBy("query_id").agg(F.min("q").alias("q"))
    blocks = max(1, -(-asked.count() // query_rows))

    def pack(table: pa.Table) -> pa.Table:
        ids, x = table.column("query_id").to_numpy(), _matrix(table.column("q"), dim)
        return pa.table({"block": table.column("block")[:1].cast(pa.int32()), "query_ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "queries": pa.array([x.astype("<f4").tobytes()], pa.binary())})

    dealt = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    packed = dealt.groupBy("block").applyInArrow(pack, "block int, query_ids binary, queries binary")
    shards = index.shards.select("shard").distinct().count()
    meeting = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(shards - 1, 0)))))
    # Every pair has its own partition: a block and a shard are the most that a task holds.
    pairs = meeting.join(index.shards, "shard").repartition(blocks * shards, "block", "shard")
    sent = queries.sparkSession.sparkContext.broadcast(quantizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                stages = len(sent.value.books)
                shard = Shard(np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["vectors"], "<f4").reshape(-1, dim), np.frombuffer(r["codes"], np.uint8).reshape(-1, stages), np.frombuffer(r["norms"], "<f4"), np.frombuffer(r["firsts"], "<i8"))
                got = shard.search(sent.value, np.frombuffer(r["query_ids"], "<i8"), np.frombuffer(r["queries"], "<f4").reshape(-1, dim), k, candidates, metric)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
