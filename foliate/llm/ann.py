"""Approximate maximum inner product search: anisotropic four-bit product codes, table scan, exact reranking.

Vectors are cut into subspaces of two dimensions with 16 codewords each (four bits; two codes share a byte). Training
and encoding weigh the part of the residual that is parallel to the vector ``eta`` times as much as the rest, since
only that part moves the scores of its near queries. Codebooks are fitted on at most ``sample`` vectors of smallest
id hash; every vector is encoded. A scan sums one 256-entry table lookup per byte for a block of candidates and scores
the best ``keep`` of the block exactly, in double precision, on the original vectors. That gives a floor under the k-th
best score. The code's score is off by the query's length times the length of the residual at most, which the index
holds; every candidate that this bound lets reach the floor is scored exactly too, so none of the exact top k is lost,
however many near copies a group has. Where many candidates stay open, one matrix product thins them first. A block's
exact top k per query leaves the task, so nothing is joined back. Queries go through one block of about QUERY_BLOCK after
the other: its vectors are broadcast (64 dimensions make 8 MB) and freed when its results are written, so neither the
driver nor the plan grows with the number of queries.

Defined cases: vectors that are null, of another length than most, zero, or hold null or non-finite components take no
part; a query with fewer candidates gets them all; ties go to the smaller id; rows that repeat an id (or are equal in
all) are queries of their own, and candidates of each other; null ids take no part; extra columns are ignored, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foliate.runtime import materialise, materialise_parts

WIDTH, CODES = 2, 16
QUERY_BLOCK = 16_384
CANDIDATE_ROWS = 8_192
MANY = 1 / 32  # share of open candidates from which a matrix product thins them
FOUND = "array<struct<score:double,id:long,row:long>>"
INDEX = "row long, id long, vector binary, code binary, error double"


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def shares(eta: float, unit: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Anisotropic loss of residuals: eta times the part along the vector, once the rest."""
    along = np.einsum("nd,nd->n", residual, unit)
    return np.einsum("nd,nd->n", residual, residual) + (eta - 1) * along * along


class Codebook:
    def __init__(self, dim: int, eta: float):
        self.dim, self.parts = dim, -(-dim // WIDTH)
        self.parts += self.parts % 2
        self.eta = eta
        self.words = np.zeros((self.parts, CODES, WIDTH))

    def padded(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.parts * WIDTH))
        out[:, : self.dim] = x
        return out.reshape(len(x), self.parts, WIDTH)

    def assign(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent over subspaces on the anisotropic loss."""
        n = len(x)
        rows = np.arange(n)
        unit = x / np.sqrt(np.einsum("npw,npw->n", x, x))[:, None, None]
        # residual norm and its component along the vector, for each codeword of each subspace
        diff = x[:, :, None, :] - self.words[None]
        square = np.einsum("npcw,npcw->npc", diff, diff)
        along = np.einsum("npcw,npw->npc", diff, unit)
        codes = square.argmin(2)
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(sweeps):
            for p in range(self.parts):
                rest = total - along[rows, p, codes[:, p]]
                loss = square[:, p] + (self.eta - 1) * ((along[:, p] + rest[:, None]) ** 2)
                codes[:, p] = loss.argmin(1)
                total = rest + along[rows, p, codes[:, p]]
        return codes

    def fit(self, sample: np.ndarray, rounds: int = 8, seed: int = 7) -> None:
        x = self.padded(sample)
        pick = np.random.default_rng(seed)
        for p in range(self.parts):
            self.words[p] = x[pick.choice(len(x), CODES, len(x) < CODES), p]
        unit = x / np.sqrt(np.einsum("npw,npw->n", x, x))[:, None, None]
        for turn in range(rounds):
            codes = self.assign(x, 0 if turn < rounds // 2 else 1)
            residual = x - self.words[np.arange(self.parts)[None], codes]
            along = np.einsum("npw,npw->np", residual, unit)
            total = along.sum(1)
            for p in range(self.parts):
                rest = total - along[:, p]
                u, c = unit[:, p], codes[:, p]
                # (sum of I + (eta-1) u u^T) word = sum of (x + (eta-1) u (u.x + rest))
                gain = (self.eta - 1) * u * (np.einsum("nw,nw->n", u, x[:, p]) + rest)[:, None]
                right = np.zeros((CODES, WIDTH))
                np.add.at(right, c, x[:, p] + gain)
                left = np.zeros((CODES, WIDTH, WIDTH))
                np.add.at(left, c, np.eye(WIDTH) + (self.eta - 1) * u[:, :, None] * u[:, None, :])
                filled = np.bincount(c, minlength=CODES) > 0
                self.words[p, filled] = np.linalg.solve(left[filled], right[filled][:, :, None])[:, :, 0]
                along[:, p] = np.einsum("nw,nw->n", x[:, p] - self.words[p, c], u)
                total = rest + along[:, p]

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        codes = np.concatenate([self.assign(self.padded(vectors[i : i + 2048])) for i in range(0, len(vectors), 2048)])
        return (codes[:, ::2] * CODES + codes[:, 1::2]).astype(np.uint8)

    def errors(self, vectors: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Lengths of the residuals that the codes leave."""
        codes = np.stack([packed // CODES, packed % CODES], 2).reshape(len(packed), -1)
        residual = self.padded(vectors) - self.words[np.arange(self.parts)[None], codes]
        return np.sqrt(np.einsum("npw,npw->n", residual, residual))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(bytes, 256, queries) partial scores: both four-bit tables of a byte, added up."""
        dots = np.einsum("qpw,pcw->pcq", self.padded(queries), self.words)
        return (dots[::2, :, None, :] + dots[1::2, None, :, :]).reshape(self.parts // 2, CODES * CODES, -1).astype(np.float32)


def fit_codebook(vectors: DataFrame, dim: int, sample: int, threshold: float = 0.2) -> Codebook:
    """``vectors``: id, vector. The bounded sample is the rows of smallest id hash."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()
    book = Codebook(dim, max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2)))
    if rows:
        book.fit(np.array([r[0] for r in rows], np.float64))
    return book


def build_index(vectors: DataFrame, book: Codebook) -> DataFrame:
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows:
                x = np.asarray(batch.column(2).flatten(), np.float64).reshape(batch.num_rows, -1)
                codes = book.encode(x)
                packed = [pa.array([v.tobytes() for v in m], pa.binary()) for m in (x.astype("<f8"), codes)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed, pa.array(book.errors(x, codes))], ["row", "id", "vector", "code", "error"])

    return vectors.mapInArrow(run, INDEX)


def products(q: np.ndarray, x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Exact scores of the pairs q[rows], x[cols]."""
    step = max(1, (1 << 22) // x.shape[1])
    return np.concatenate([(q[rows[i : i + step]] * x[cols[i : i + step]]).sum(1) for i in range(0, len(rows), step)] or [np.empty(0)])


def scan(index: DataFrame, queries, book: Codebook, k: int, keep: int) -> DataFrame:
    """query, found array<struct<score, id, row>>: exact top k of each task's candidates, for a broadcast block of queries.

    Queries and candidates are rows (``query`` is the row of a query), so rows of one id stay apart.
    """

    def block(rows_: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, error: np.ndarray, asking: np.ndarray, q: np.ndarray, best: list) -> None:
        step = max(1, (1 << 22) // max(len(ids), CANDIDATE_ROWS))  # 16 MB of scores at a time
        length = np.sqrt(np.einsum("nd,nd->n", x, x))
        for s in range(0, len(asking), step):
            part = q[s : s + step]
            tables = book.tables(part)
            scores = np.zeros((len(ids), len(part)), np.float32)
            for j in range(codes.shape[1]):
                scores += tables[j][codes[:, j]]
            own = rows_[None] == asking[s : s + step, None]
            scores = np.where(own, -np.inf, scores.T)
            size = np.sqrt(np.einsum("qd,qd->q", part, part))[:, None]
            # a floor under the k-th best score: of earlier blocks, and of the best by code
            floor = np.array([b[0][k - 1] if b is not None and len(b[0]) >= k else -np.inf for b in best[s : s + step]])
            if len(ids) > keep >= k:
                top = np.argpartition(scores, len(ids) - keep, axis=1)[:, len(ids) - keep :]
                first = products(part, x, np.repeat(np.arange(len(part)), keep), top.ravel()).reshape(top.shape)
                first[np.take_along_axis(own, top, 1)] = -np.inf
                floor = np.maximum(floor, np.partition(first, keep - k, axis=1)[:, keep - k])
            # the residual's part of the score, and the rounding of single precision
            bound = size * (error * (1 + 1e-9) + book.parts * 2.0**-22 * (length + error))
            seen = np.isfinite(scores)
            open_ = ~own & ~(seen & (scores + bound < floor[:, None]))
            if open_.mean() > MANY:
                whole = np.where(open_, part @ x.T, -np.inf)
                off = x.shape[1] * 2.0**-50 * size * length  # products may differ in the last bits
                if len(ids) > k:
                    floor = np.maximum(floor, np.partition(whole - off, len(ids) - k, axis=1)[:, len(ids) - k])
                open_ &= ~(whole + off < floor[:, None])
            rows, cols = np.nonzero(open_)
            exact = products(part, x, rows, cols)
            order = np.lexsort((rows_[cols], ids[cols], -exact, rows))
            rows, cols, exact = rows[order], cols[order], exact[order]
            start = np.searchsorted(rows, np.arange(len(part)))
            end = np.append(start[1:], len(rows))
            for i in range(len(part)):
                a, b = start[i], min(end[i], start[i] + k)
                old = best[s + i]
                new = exact[a:b], ids[cols[a:b]], rows_[cols[a:b]]
                if old is not None:
                    new = tuple(np.append(*pair) for pair in zip(old, new))
                    pick = np.lexsort((new[2], new[1], -new[0]))[:k]
                    new = tuple(v[pick] for v in new)
                best[s + i] = new

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, q = queries.value
        best: list = [None] * len(asking)
        for batch in stream:
            for at in range(0, batch.num_rows, CANDIDATE_ROWS):
                part = batch.slice(at, CANDIDATE_ROWS)
                x = np.frombuffer(b"".join(part.column(2).to_pylist()), "<f8").reshape(part.num_rows, -1)
                codes = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                block(np.asarray(part.column(0)), np.asarray(part.column(1)), x, codes, np.asarray(part.column(4)), asking, q, best)
        have = [i for i, b in enumerate(best) if b is not None and len(b[0])]
        if have:
            flat = [pa.array(np.concatenate([best[i][j] for i in have])) for j in range(3)]
            ends = np.cumsum([0] + [len(best[i][0]) for i in have])
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, ["score", "id", "row"]))
            yield pa.RecordBatch.from_arrays([pa.array(asking[have], pa.int64()), found], ["query", "found"])

    return index.mapInArrow(run, f"query long, found {FOUND}")


def best_of(found: Column, k: int) -> Column:
    """The k best of FOUND: largest score, then smallest id."""
    keyed = F.transform(found, lambda x: F.struct((-x["score"]).alias("minus"), x["id"].alias("id"), x["row"].alias("row")))
    top = F.slice(F.sort_array(keyed), 1, k)
    return F.transform(top, lambda x: F.struct((-x["minus"]).alias("score"), x["id"].alias("id"), x["row"].alias("row")))


def search(
    vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 20, keep: int = 64, sample: int = 8_192
) -> DataFrame:
    """query_id, rank, vec_id, score for each row that ``is_query`` selects, against all other rows."""
    spark = vectors.sparkSession
    good = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    kept = good.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("asks"))
    length = kept.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = length[0] if length else 1
    # a row's number stays what it is once it is written
    kept = materialise(kept.filter(F.size("vector") == dim).withColumn("row", F.monotonically_increasing_id()))
    book = fit_codebook(kept.select("id", "vector"), dim, sample)
    index = materialise(build_index(kept.select("row", "id", "vector"), book))
    asking = kept.filter("asks").select("row", "vector")
    n_blocks = -(-asking.count() // QUERY_BLOCK)
    n_blocks *= 2 if n_blocks > 1 else 1  # hashed rows fill blocks unevenly

    def parts() -> Iterator[DataFrame]:
        """One block of queries after the other is sent out, scanned, written and freed."""
        for b in range(n_blocks):
            rows = asking.filter(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == b).collect()
            if rows:
                queries = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)))
                found = scan(index, queries, book, k, keep)
                # lists of tasks are merged in two steps, so no row gathers a list per task of a large scan
                merged = found.groupBy("query", (F.spark_partition_id() % 64).alias("part")).agg(best_of(F.flatten(F.collect_list("found")), k).alias("found"))
                yield merged.groupBy("query").agg(best_of(F.flatten(F.collect_list("found")), k).alias("found"))
                queries.destroy()

    merged = materialise_parts(spark, parts())
    if merged is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    names = kept.filter("asks").select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    top = merged.join(names, "query").select("query_id", F.posexplode("found").alias("at", "hit"))
    return top.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
