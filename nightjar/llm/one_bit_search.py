"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Each vector is divided by its length, padded and turned by one random rotation; the signs are its code. With
``align`` = the inner product of the turned unit vector and its code (scaled to length one), the inner product with a
query is estimated from the packed bits as ``norm * <code, turned query> / align``; the error of the estimate exceeds
``norm * |query| * sqrt((1 - align^2) / align^2) * width / sqrt(bits - 1)`` only with a probability that falls like
exp(-c * width^2). Every block of candidates is scanned by bits. The k best by estimate are scored first, on the original
vectors in double precision; the k-th of these scores is a floor that the true k-th can't fall below, and of the others
only those whose upper bound reaches it are scored too. So the result misses a true neighbour only where a bound fails.

Blocks of candidates and blocks of queries meet in tasks of bounded size: a stated query set against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

CANDIDATE_BLOCK, QUERY_BLOCK = 16_384, 4_096
CHUNK = 256  # queries estimated at a time inside a task
PAIRS = 65_536  # pairs scored at a time


def rotation(dims: int, bits: int, seed: int) -> np.ndarray:
    """The first ``dims`` rows of a random orthogonal matrix: turns a vector padded with zeros to ``bits``."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dims, bits]).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dims].astype(np.float64)


def code_bits(dims: int, least: int = 512) -> int:
    return max(least, -(-dims // 64) * 64)


def encode_vectors(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, length and alignment of each row."""
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    turned = (vectors / norms[:, None]) @ turn
    signs = turned >= 0
    align = np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1])
    return np.packbits(signs, axis=1), norms, align


def exact(queries: np.ndarray, q: np.ndarray, vectors: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of the row pairs (q, c) in double precision, summed in the order of the components."""
    total = np.zeros(len(q))
    for start in range(0, len(q), PAIRS):
        left, right = queries[q[start:start + PAIRS]], vectors[c[start:start + PAIRS]]
        for j in range(queries.shape[1]):
            total[start:start + PAIRS] += left[:, j] * right[:, j]
    return total


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, packed: np.ndarray, norms: np.ndarray, align: np.ndarray, turn: np.ndarray, k: int, width: float) -> tuple[pd.DataFrame, int]:
    """The ``k`` best of one block for every query of one block, and how many pairs were scored exactly."""
    bits = turn.shape[1]
    signs = np.unpackbits(packed, axis=1, count=bits).astype(np.float32) * 2 - 1
    scale = (norms / align / np.sqrt(bits)).astype(np.float32)
    error = (norms * np.sqrt(np.maximum(0, 1 - align * align)) / align * width / np.sqrt(bits - 1)).astype(np.float32)
    out, scored = [], 0
    for start in range(0, len(queries), CHUNK):
        own, own_ids = queries[start:start + CHUNK], query_ids[start:start + CHUNK]
        lengths = np.sqrt((own * own).sum(axis=1)).astype(np.float32)
        estimate = ((own @ turn).astype(np.float32) @ signs.T) * scale
        estimate[own_ids[:, None] == ids[None, :]] = -np.inf
        q, c, scores = (np.empty(0, dtype=kind) for kind in (np.int64, np.int64, np.float64))
        floor = np.full(len(own), -np.inf)
        if len(ids) > k:
            first = np.argpartition(estimate, len(ids) - k, axis=1)[:, len(ids) - k:]
            q, c = np.repeat(np.arange(len(own)), k), first.reshape(-1)
            scores = np.where(estimate[q, c] == -np.inf, -np.inf, exact(own, q, vectors, c))
            floor = scores.reshape(-1, k).min(axis=1)
            estimate[q, c] = -np.inf
        estimate += lengths[:, None] * error
        more = np.nonzero((estimate >= floor[:, None]) & (estimate > -np.inf))
        scored += len(q) + len(more[0])
        q, c, scores = np.concatenate([q, more[0]]), np.concatenate([c, more[1]]), np.concatenate([scores, exact(own, more[0], vectors, more[1])])
        real = scores > -np.inf
        q, c, scores = q[real], c[real], scores[real]
        order = np.lexsort((ids[c], -scores, q))
        q, c, scores = q[order], c[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        best = rank < k
        out.append(pd.DataFrame({"query_id": own_ids[q[best]], "vec_id": ids[c[best]], "score": scores[best]}))
    return pd.concat(out), scored


def usable(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """``(vec_id, vector array<double>, dims)`` of vectors that can be compared; repeated rows once.

    Null, empty and zero vectors and those holding null, infinite or not-a-number components take no part.
    """
    values = embeddings.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where("vector IS NOT NULL AND vec_id IS NOT NULL")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return values.where(finite & F.exists("vector", lambda x: x != 0)).withColumn("dims", F.size("vector")).distinct()


def nearest(embeddings: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", width: float = 3.0, seed: int = 8) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest other rows of every row for which ``queries`` (on ``vec_id``) holds.

    Nearest first by inner product, ties to the smaller id; fewer than ``k`` if there are fewer candidates. Only vectors
    of equal dimension are compared. A vector that is equal to the query under another id is a candidate; rows with equal
    id and vector count once, and an id is never its own neighbour. Other columns are ignored. An empty table gives an
    empty result.
    """
    rows = usable(embeddings, key, vector)
    sizes = rows.groupBy("dims").agg(F.count(F.lit(1)).alias("candidates"), F.count(F.when(queries, 1)).alias("asked")).where("asked > 0")
    blocks = sizes.select("dims", F.ceil(F.col("candidates") / CANDIDATE_BLOCK).cast("int").alias("cb"), F.ceil(F.col("asked") / QUERY_BLOCK).cast("int").alias("qb"))
    rows = rows.join(blocks, "dims")
    place = F.xxhash64(F.lit(seed), F.col("vec_id"))
    # a candidate is a row of its own block for every query block, a query one of its own block for every candidate block
    candidates = rows.withColumn("c", F.pmod(place, F.col("cb")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
    asked = rows.where(queries).withColumn("q", F.pmod(place, F.col("qb")).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cb") - 1)))
    coded = candidates.select("dims", "c", "q", "vec_id", "vector").mapInPandas(
        encode_frames(seed), "dims int, c int, q int, vec_id long, vector binary, code binary, norm double, align double")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        dims = int(left["dims"].iloc[0])
        vectors = np.frombuffer(b"".join(left["vector"]), dtype=np.float64).reshape(len(left), dims)
        packed = np.frombuffer(b"".join(left["code"]), dtype=np.uint8).reshape(len(left), -1)
        found, _ = search_block(
            right["vec_id"].to_numpy(), np.array(right["vector"].tolist(), dtype=np.float64), left["vec_id"].to_numpy(), vectors, packed,
            left["norm"].to_numpy(), left["align"].to_numpy(), rotation(dims, code_bits(dims), seed), k, width)
        return found

    met = coded.groupBy("dims", "c", "q").cogroup(asked.select("dims", "c", "q", "vec_id", "vector").groupBy("dims", "c", "q")).applyInPandas(
        meet, "query_id long, vec_id long, score double")
    nearest_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # rows of one id with unlike vectors: the better pair of an id counts
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def encode_frames(seed: int):
    """Map function that adds the code and the correction scalars, and packs the vector."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns: dict[int, np.ndarray] = {}
        for frame in frames:
            for dims, part in frame.groupby("dims"):
                dims = int(dims)
                if dims not in turns:
                    turns[dims] = rotation(dims, code_bits(dims), seed)
                vectors = np.array(part["vector"].tolist(), dtype=np.float64)
                packed, norms, align = encode_vectors(vectors, turns[dims])
                yield part.assign(vector=[v.tobytes() for v in vectors], code=[p.tobytes() for p in packed], norm=norms, align=align)

    return run
