"""Nearest neighbours by cosine with multi-index hashing over learned binary codes.

1. Learn: the directions are centred on nothing but rotated (iterative quantisation: the rotation that brings the
   directions closest to the corners of a cube), so that signs lose least.  Sums over all rows, ten small passes.
2. Code: a row's code is the signs of its rotated direction, 64 bits at most.
3. Radius: exact neighbours of a fixed number of rows, found among all rows, say how far apart in code true
   neighbours lie; the radius holds ``reach`` of them.
4. Index: codes are split into ``m`` substrings, each an index of its own, its buckets gathered by their first bits
   into units.  By pigeonhole, codes within the radius r = m * q + a lie within q in one of the first a + 1
   substrings or within q - 1 in another, so a query is sent to the units whose first bits lie that near to its own.
   m and the number of bits are those that send least; where the radius is wide (directions without structure)
   that is every unit of one index, where it is narrow a few.
5. Probe: in a unit the codes alone say which rows lie within the radius; only these rows' exact cosines are taken, and
   the ``k`` best kept; the units' answers are merged.  Where a query is sent to every unit anyway, the radius excludes nothing.
6. Widen: a query with fewer than ``k`` results, or whose k-th is so far that nearer rows may well lie outside the
   radius, is asked again with a wider one, in the end against all rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ngrams import mix64
from .shared import written

ROUNDS = 8
UNIT = 8_000
PROBES = 256
REACH = 0.97
#: Share of a unit within the radius from which cosines are taken by one product of all.
DENSE = 0.05
SCHEMA = "vec_id bigint, neighbour bigint, cosine double"


def _rows(batch: pa.RecordBatch, name: str = "v") -> np.ndarray:
    column = batch.column(batch.schema.names.index(name))
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


def unit_vectors(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """``id, v`` (packed float32 of length 1) of the usable rows, and their dimension: the commonest one."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.where("id IS NOT NULL AND size(x) > 0 AND forall(x, e -> e IS NOT NULL AND e = e AND abs(e) < 1e300) AND exists(x, e -> e != 0)")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = common[0] if common else 0

    def normal(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            x /= np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
            x = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "v"])

    return rows.where(F.size("x") == dims).mapInArrow(normal, "id bigint, v binary"), dims


def _sum(rows: DataFrame, of, shape: tuple[int, int]) -> np.ndarray:
    """Sum of the matrices that ``of`` makes of each batch; one matrix a partition comes to one task, and one here."""

    def part(batches):
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += of(_rows(batch))
        yield pa.RecordBatch.from_pydict({"m": [total.tobytes()]}, schema=pa.schema([("m", pa.binary())]))

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(shape)
        for m in table.column("m").to_pylist():
            total += np.frombuffer(m).reshape(shape)
        return pa.table({"m": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(part, "m binary").groupBy(F.pmod(F.xxhash64("m"), F.lit(32))).applyInArrow(add, "m binary")
    found = parts.collect()  # 32 small matrices at most
    return sum((np.frombuffer(r.m).reshape(shape) for r in found), np.zeros(shape))


def learn_rotation(rows: DataFrame, dims: int, bits: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """A dims x bits projection: the main directions, rotated by iterative quantisation."""
    cov = _sum(rows, lambda v: v.T.astype(np.float64) @ v, (dims, dims))
    main = np.linalg.eigh(cov)[1][:, ::-1][:, :bits]
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        w = (main @ turn).astype(np.float32)
        cross = _sum(rows, lambda v, w=w: np.where(v @ w >= 0, 1.0, -1.0).T @ (v @ main), (bits, bits))
        u, _, vt = np.linalg.svd(cross)
        turn = (u @ vt).T
    return (main @ turn).astype(np.float32)


def encode(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sign bits, the first in the highest place of ``bits``."""
    bits = w.shape[1]
    return (((v @ w) >= 0).astype(np.uint64) << np.arange(bits - 1, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k largest of each row, and of those within rounding of the k-th."""
    if sims.shape[1] <= k:
        return np.isfinite(sims)
    kth = np.partition(sims, sims.shape[1] - k, axis=1)[:, -k]
    return (sims >= (kth - np.float32(2e-6))[:, None]) & np.isfinite(sims)


def ball(bits: int, radius: int) -> int:
    return sum(math.comb(bits, i) for i in range(min(bits, radius) + 1)) if radius >= 0 else 0


def plan(n: int, bits: int, radius: int, unit: int = UNIT) -> tuple[int, int, list[int]]:
    """(substrings, first bits, radius for each substring) that send a row to the fewest units."""
    best = None
    for m in range(1, bits + 1):
        width = bits // m
        first = min(width, max(0, math.ceil(math.log2(max(1, n / unit)))))
        q, a = divmod(radius, m)
        each = [q if j <= a else q - 1 for j in range(m)]
        cost = sum(ball(first, r) for r in each) + 0.01 * m
        if best is None or cost < best[0]:
            best = (cost, m, first, each)
    return best[1:]


def _masks(bits: int, radius: int) -> np.ndarray:
    every = np.arange(1 << bits, dtype=np.uint64)
    return every[np.bitwise_count(every) <= radius] if radius >= 0 else every[:0]


def _firsts(codes: np.ndarray, bits: int, m: int, first: int, j: int) -> np.ndarray:
    """The first bits of substring j."""
    start = j * (bits // m)
    return codes >> np.uint64(bits - start - first) & np.uint64((1 << first) - 1) if first else np.zeros(len(codes), np.uint64)


def calibrated_radius(coded: DataFrame, dims: int, bits: int, k: int, probes: int = PROBES, reach: float = REACH) -> int:
    """The Hamming radius within which ``reach`` of the ``k`` exact neighbours of ``probes`` rows lie, sought among all rows."""
    asked = coded.orderBy(F.xxhash64("id", "v"), "id").limit(probes).collect()
    if not asked:
        return 0
    ids = np.array([r.id for r in asked], np.int64)
    codes = np.array([r.code for r in asked], np.int64).view(np.uint64)
    q = np.frombuffer(b"".join(bytes(r.v) for r in asked), np.float32).reshape(len(asked), dims)

    def near(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            sims = q @ _rows(batch).T
            other = batch.column(0).to_numpy()
            sims[ids[:, None] == other[None, :]] = -np.inf
            at, who = np.nonzero(_top(sims, k))
            far = np.bitwise_count(codes[at] ^ batch.column(2).to_numpy().view(np.uint64)[who]).astype(np.int32)
            held.append((at.astype(np.int32), sims[at, who].astype(np.float64), far))
        if held:
            at, sim, far = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((far, -sim, at))
            best = order[np.arange(len(at)) - np.searchsorted(at[order], at[order]) < k]
            yield pa.RecordBatch.from_arrays([pa.array(x[best]) for x in (at, sim, far)], names=["q", "sim", "far"])

    found = coded.select("id", "v", "code").mapInArrow(near, "q int, sim double, far int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "far"))
    far = found.withColumn("r", rank).where(F.col("r") <= k).groupBy("far").count().orderBy("far").collect()  # 65 rows at most
    total, held = sum(r[1] for r in far), 0
    for r in far:
        held += r[1]
        if held >= reach * total:
            return r[0]
    return bits


def settling_cosine(bits: int, radius: int, reach: float = REACH) -> float:
    """The least cosine at which codes lie within the radius with probability ``reach``, each sign differing with that of a random plane."""
    low, high = 0.0, 1.0  # share of planes between two rows
    for _ in range(50):
        p = (low + high) / 2
        inside = sum(math.comb(bits, i) * p**i * (1 - p) ** (bits - i) for i in range(min(bits, radius) + 1))
        low, high = (p, high) if inside >= reach else (low, p)
    return math.cos(math.pi * low)


def _search(k: int, bits: int, dims: int, radius: int):
    """Function for a unit: each query's best ``k`` among the stored rows whose codes lie within the radius."""

    def search(stored: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if stored.num_rows and asked.num_rows:
            ids, v, codes = _unpack(stored, dims)
            q_ids, q_v, q_codes = _unpack(asked, dims)
            most = k * int(np.unique(ids, return_counts=True)[1].max())  # rows of one id count once
            for s in range(0, len(q_ids), 512):
                e = slice(s, s + 512)
                for t in range(0, len(ids), 2 * UNIT):
                    f = slice(t, t + 2 * UNIT)
                    near = q_ids[e, None] != ids[None, f]
                    if radius < bits:
                        near &= np.bitwise_count(q_codes[e, None] ^ codes[None, f]) <= radius
                    if np.count_nonzero(near) > DENSE * near.size:  # a product of all is less work than gathering these
                        at, who = np.nonzero(_top(np.where(near, q_v[e] @ v[f].T, np.float32(-np.inf)), most))
                    else:
                        at, who = np.nonzero(near)
                    exact = np.empty(len(at))
                    for g in range(0, len(at), 100_000):
                        h = slice(g, g + 100_000)
                        exact[h] = np.einsum("ij,ij->i", q_v[e][at[h]].astype(np.float64), v[f][who[h]].astype(np.float64))
                    order = np.lexsort((-exact, at))
                    place = np.arange(len(at)) - np.searchsorted(at[order], at[order])
                    last = order[place == most - 1]
                    kth = np.full(len(near), -np.inf)
                    kth[at[last]] = exact[last]
                    best = np.flatnonzero(exact >= kth[at] - 1e-9)  # rows as near as the k-th, to the places that count, stay too
                    out.append((q_ids[e][at[best]], ids[f][who[best]], exact[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"vec_id": columns[0], "neighbour": columns[1], "cosine": columns[2]})

    return search


def _unpack(table: pa.Table, dims: int):
    join = lambda c: b"".join(table.column(c).to_pylist())
    return np.frombuffer(join("ids"), np.int64), np.frombuffer(join("vs"), np.float32).reshape(-1, dims), np.frombuffer(join("codes"), np.uint64)


def nearest_neighbours(df: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", reach: float = REACH, radius: int | None = None, unit: int = UNIT, every: int = 1) -> DataFrame:
    """The ``k`` nearest others by cosine of each query: ``vec_id, neighbour, cosine``, ``k`` rows for each query if there are so many others.

    The queries are the rows whose id is divisible by ``every``, by default all; each is held against all rows.
    Exact among the codes within the query's radius, at first the one that holds ``reach`` of the true neighbours of
    ``PROBES`` rows; exact where that sends rows to every unit.  It widens for a query until ``k`` are found and codes
    as near as the k-th lie within it with probability ``reach``.  With ``radius`` it is that one for all queries, and
    they may have fewer than ``k``.  Of equal cosines (to 9 places) the smaller ids come first.  Rows of one id are never each
    other's neighbours; repeated rows and rows that share an id count as one row for an id, at its best cosine.  Null ids and vectors
    that are null, empty, zero, not finite or not of the commonest length have no neighbours and are none.  Other
    columns are not read; an empty table gives no rows.
    """
    if k < 1 or every < 1:
        raise ValueError("k and every must be positive")
    rows, dims = unit_vectors(df, id_col, vector_col)
    if not dims:
        return df.sparkSession.createDataFrame([], SCHEMA)
    rows = written(rows, "ann_vectors")
    bits = min(64, dims)
    w = learn_rotation(rows, dims, bits)

    def code(batches):
        for batch in batches:
            codes = encode(_rows(batch), w) if batch.num_rows else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes.view(np.int64))], names=["id", "v", "code"])

    coded = written(rows.mapInArrow(code, "id bigint, v binary, code bigint").distinct(), "ann_codes")
    n = coded.count()
    queries = coded if every == 1 else written(coded.where(F.pmod("id", F.lit(every)) == 0), "ann_queries")
    n_queries = n if every == 1 else queries.count()

    # A unit's rows are dealt further to ``deal`` parts of its queries, so no task holds more than some thousands of either.
    def spread(rows: DataFrame, asked: bool, m: int, first: int, each: list[int], deal: int):
        def send(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, codes, v = batch.column(0).to_numpy(), batch.column(2).to_numpy().view(np.uint64), _rows(batch)
                part = (mix64(ids.astype(np.uint64)) % np.uint64(deal)).astype(np.int64)
                out = []
                for j in range(m):
                    own = _firsts(codes, bits, m, first, j)
                    for mask in _masks(first, each[j]) if asked else _masks(first, 0) if each[j] >= 0 else ():
                        unit_of = (own ^ mask).astype(np.int64) + (j << first)
                        for p in [None] if asked else range(deal):
                            key = unit_of * deal + (part if p is None else p)
                            order = np.argsort(key, kind="stable")
                            edges = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0, [True]]))
                            out += [(int(key[order[s]]), order[s:e]) for s, e in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int64()), *[pa.array([x[o[1]].tobytes() for o in out], pa.binary()) for x in (ids, v, codes)]], names=["key", "ids", "vs", "codes"]
                )

        return rows.select("id", "v", "code").mapInArrow(send, "key bigint, ids binary, vs binary, codes binary")

    def probe(asked: DataFrame, n_asked: int, radius: int, m: int, first: int, each: list[int]) -> DataFrame:
        sent = n_asked * sum(ball(first, r) for r in each) / max(1, m << first)  # queries in a unit
        deal = max(1, math.ceil(sent / (2 * unit)))
        stored, queries = spread(coded, False, m, first, each, deal), spread(asked, True, m, first, each, deal)
        found = stored.groupBy("key").cogroup(queries.groupBy("key")).applyInArrow(_search(k, bits, dims, radius), SCHEMA)
        best = found.groupBy("vec_id", "neighbour").agg(F.round(F.max("cosine"), 9).alias("cosine"))
        rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "neighbour"))
        return best.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")

    if radius is not None:
        return probe(queries, n_queries, radius, *plan(n, bits, radius, unit))
    radius = calibrated_radius(coded, dims, bits, k, reach=reach)
    asked, n_asked, done = queries, n_queries, None
    while True:
        m, first, each = plan(n, bits, radius, unit)
        everywhere = any(r >= first for r in each)
        found = probe(asked, n_asked, bits if everywhere else radius, m, first, each)
        if everywhere:
            return found if done is None else done.unionByName(found)
        found = written(found, "ann_found")
        settled = found.groupBy("vec_id").agg(F.count("*").alias("n"), F.min("cosine").alias("least"))
        settled = settled.where((F.col("n") >= k) & (F.col("least") >= settling_cosine(bits, radius, reach))).select(F.col("vec_id").alias("id"))
        kept = found.join(settled.withColumnRenamed("id", "vec_id"), "vec_id", "left_semi")
        done = kept if done is None else done.unionByName(kept)
        asked = written(asked.join(settled, "id", "left_anti").select("id", "v", "code"), "ann_asked")
        n_asked = asked.count()
        if not n_asked:
            return done
        radius = min(bits, max(radius + 2, 2 * radius))
