"""Exact top-k search by inner product with bounds from segment statistics.

Vectors are cut into segments; of each the mean and the length of the
deviations from it are kept, at several resolutions. The distance of two
vectors is at least that of their segments' statistics, coarse or fine:

    |q - x|^2 >= sum over segments of len (mean_q - mean_x)^2 + (dev_q - dev_x)^2

and the inner product is (|q|^2 + |x|^2 - |q - x|^2) / 2, so a lower bound on
the distance bounds the score from above. Coarse to fine, candidates whose
bound is below the k-th best score found so far go; the others' scores are
computed exactly.

Vectors are turned first (a rotation keeps distances) so that few coordinates
hold most of their length, as the segments of these then tell most. The
rotation and a first floor for each query come from a bounded sample of the
rows, chosen by hash; both only make bounds and floors better, results are
exact whatever the sample holds.

Candidates are packed into blocks of bounded size and stay where they are
dealt once, some blocks a part; blocks of queries, which are few, are copied
to the parts and stream past the candidates, their floors rising. So a task
holds one part and one block of queries, whatever the tables' sizes, and gives
k rows a query at most, none below the first floor.

How much coarse bounds save depends on the vectors: where all coordinates
weigh alike (as in tests of random vectors) only the two finest resolutions
prune, at the cost of bounds for all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import release_memory, shuffle_partitions

#: Rows of a block of queries, of candidates, of a part, and of the sample.
QUERY_ROWS, CANDIDATE_ROWS, PART_ROWS, SAMPLE_ROWS = 1024, 4096, 262_144, 2048
#: Numbers of segments, coarse to fine. Longest vectors that are turned.
RESOLUTIONS, TURNED = (1, 4, 16, 32, 48), 512
_PACKED = "dim int, ids binary, vectors binary, width string"


def quantize(c: Column, factor: float = 256.0) -> Column:
    """floor(factor * x) of each component as long; null for vectors that are null or hold a null, a NaN or an infinity."""
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(c.isNotNull() & fine, F.transform(c, lambda x: F.floor(factor * x.cast("double")).cast("long")))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """For each row the segments' means, each times the root of the segment's length, then the lengths of the deviations."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    means, devs = [], []
    for a, b in zip(cuts, cuts[1:]):
        part = x[:, a:b]
        m = part.mean(1)
        means.append(m * np.sqrt(b - a))
        devs.append(np.sqrt(((part - m[:, None]) ** 2).sum(1)))
    return np.stack([*means, *devs], 1)


def _starts(ids: np.ndarray) -> np.ndarray:
    """Places in sorted ids where another id starts."""
    return np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])[: len(ids)])


def turn(x: np.ndarray) -> np.ndarray:
    """The rotation after which leading coordinates hold as much of the rows' squares as they can."""
    square, axes = np.linalg.eigh(x.T.astype(float) @ x)
    return axes[:, ::-1]


def survivors(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, floor: np.ndarray, axes: np.ndarray | None = None) -> np.ndarray:
    """Which candidates (in order of id) may be among each query's k best, by bounds from segment statistics and the floors, which rise."""
    alive = q_ids[:, None] != c_ids[None, :]
    q, c = q.astype(float), c.astype(float)
    n_q, n_c = (q**2).sum(1), (c**2).sum(1)
    slack = 1e-9 * (n_q[:, None] + n_c[None, :]) + 1e-6
    t_q, t_c = (q, c) if axes is None else (q @ axes, c @ axes)
    if q.shape[1] and len(c):
        for level, segments in enumerate(RESOLUTIONS):
            live = np.flatnonzero(alive.any(0))
            s_q, s_c = statistics(t_q, segments), statistics(t_c[live], segments)
            apart = (s_q**2).sum(1)[:, None] + (s_c**2).sum(1)[None, :] - 2 * s_q @ s_c.T  # lower bound of the distance squared
            bound = (n_q[:, None] + n_c[None, live] - apart) / 2 + slack[:, live]
            if level == 0:  # scores of those that look best give a floor
                looks, at = np.where(alive[:, live], bound, -np.inf), np.broadcast_to(np.arange(len(live)), bound.shape)
                starts = _starts(c_ids[live])
                if len(starts) < len(live):  # of each id the row that looks best, as the floor is the k-th best id's
                    best = np.maximum.reduceat(looks, starts, axis=1)
                    same = looks == np.repeat(best, np.diff([*starts, len(live)]), axis=1)
                    looks, at = best, np.minimum.reduceat(np.where(same, at, len(live)), starts, axis=1)
                few = min(4 * k, len(starts))
                top = live[np.take_along_axis(at, np.argpartition(-looks, few - 1, axis=1)[:, :few], 1)] if few else np.zeros((len(q), 0), int)
                scores = np.where(np.take_along_axis(alive, top, 1), np.einsum("qd,qnd->qn", q, c[top]), -np.inf)
                if few >= k:
                    floor = np.maximum(floor, -np.partition(-scores, k - 1, axis=1)[:, k - 1])
            alive[:, live] &= bound >= (floor - 1e-9 * np.abs(floor))[:, None]
            if not alive.any():
                break
    return alive


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, floor: np.ndarray | None = None, axes: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """For each query its k best candidates in the block, those below the query's floor aside: (query, candidate, score). Ties go to the smaller id; a query's own id is left out.

    An id that stands several times is one candidate with the best of its scores.
    """
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    alive = survivors(q_ids, q, c_ids, c, k, np.full(len(q), -np.inf) if floor is None else floor, axes)
    exact = float(np.abs(q.astype(float)).max(initial=0) * np.abs(c.astype(float)).max(initial=0)) * max(1, q.shape[1]) < 2**52
    kind = float if exact else object
    q_x, c_x = q.astype(kind), c.astype(kind)
    out = []
    for i in np.flatnonzero(alive.any(1)).tolist():
        at = np.flatnonzero(alive[i])
        ids, scores = c_ids[at], c_x[at] @ q_x[i]
        starts = _starts(ids)
        s = np.maximum.reduceat(scores, starts)
        best = np.argsort(-s, kind="stable")[:k]  # candidates are in order of id
        out += [(int(q_ids[i]), int(ids[starts[j]]), int(s[j])) for j in best]
    return out


def _pack(rows: int):
    """Arrow batches of (vec_id, ints) to blocks of at most so many rows of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, vectors = open_.pop(dim)
            v = np.concatenate(vectors).astype(np.int64)
            width = next(t for t in ("<i2", "<i4", "<i8") if not len(v) or (np.iinfo(t).min <= v.min() and v.max() <= np.iinfo(t).max))
            return pa.record_batch([pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([v.astype(width).tobytes()]), pa.array([width])], ["dim", "ids", "vectors", "width"])

        for b in batches:
            lists = b.column(b.schema.get_field_index("ints"))
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i, v_id in enumerate(b.column(b.schema.get_field_index("vec_id")).to_pylist()):
                v = values[offsets[i] : offsets[i + 1]]
                ids, vectors = open_.setdefault(len(v), ([], []))
                ids.append(v_id)
                vectors.append(v)
                if len(ids) >= rows:
                    yield block(len(v))
        for dim in list(open_):
            yield block(dim)

    return run


def _block(dim: int, ids: bytes, vectors: bytes, width: str) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(ids, np.int64)
    return a, np.frombuffer(vectors, width).reshape(len(a), dim)


def _floors(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among the sample's ids; -inf if there are fewer."""
    starts = _starts(c_ids)
    if len(starts) < k or not q.shape[1]:
        return np.full(len(q), -np.inf)
    # a little lower than exact, should floats round
    scores = np.where(q_ids[:, None] == c_ids[None, :], -np.inf, q.astype(float) @ c.astype(float).T)
    best = np.maximum.reduceat(scores, starts, axis=1)
    at = -np.partition(-best, k - 1, axis=1)[:, k - 1]
    return at - 1e-9 * np.abs(at) - 1e-6


def _with_floors(sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            floors = []
            for dim, *block in zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in ("dim", "ids", "vectors", "width")), strict=True):
                ids, q = _block(dim, *block)
                floors.append((_floors(ids, q, *sample[dim], k) if dim in sample else np.full(len(ids), -np.inf)).tobytes())
            yield b.append_column("floor", pa.array(floors, pa.binary()))

    return run


def _search(k: int, axes: dict[int, np.ndarray]):
    """Batches of (part, floor, dim, ids, vectors, width), in order of part, candidates (without floors) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            for part, floor, dim, *block in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if part != at:
                    at, held = part, []
                ids, v = _block(dim, *block)
                if floor is None:
                    held.append((dim, ids, v))
                    continue
                low, found = np.frombuffer(floor).copy(), []
                place = {q: i for i, q in enumerate(ids.tolist())} if len(set(ids.tolist())) == len(ids) else {}
                best: dict[int, dict[int, int]] = {}
                for c_dim, c_ids, c in held:
                    if c_dim != dim:
                        continue
                    some = search_block(ids, v, c_ids, c, k, low, axes.get(dim))
                    found += some
                    for q, i, score in some if place else ():  # the floors rise with what was found
                        mine = best.setdefault(q, {})
                        mine[i] = max(mine.get(i, score), score)
                        if len(mine) > k:
                            mine.pop(min(mine, key=mine.__getitem__))
                        if len(mine) == k:
                            low[place[q]] = max(low[place[q]], min(mine.values()))
                yield pa.record_batch([pa.array([f[j] for f in found], pa.int64()) for j in range(3)], ["query_id", "vec_id", "score"])
        release_memory()

    return run


def _sample(rows: DataFrame, n: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension ids, in order, and vectors of about SAMPLE_ROWS rows, twice as many at most: those with the smallest hashes."""
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    picked = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "vec_id", "ints"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * SAMPLE_ROWS)
    found: dict[int, list] = {}
    for i, v in sorted((r[0], tuple(r[1])) for r in picked.select("vec_id", "ints").distinct().collect()):
        found.setdefault(len(v), []).append((i, v))
    return {dim: (np.array([i for i, _ in x], np.int64), np.array([v for _, v in x], np.int64).reshape(len(x), dim)) for dim, x in found.items()}


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, factor: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k highest scores among all rows with another vec_id, ties to the smaller vec_id.

    vectors: vec_id and embedding; other columns are ignored. Rows with a null
    vec_id, and vectors that are null or hold null or non-finite components
    take no part. Only vectors of one dimension are compared. Equal rows count
    once; several vectors of one vec_id are candidates each, and queries each,
    of which the best scores stay. An empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantize(F.col("embedding"), factor).alias("ints"), is_query.alias("is_query")).filter("vec_id is not null and ints is not null")
    queries = rows.filter("is_query").select("vec_id", "ints").dropDuplicates(["vec_id", "ints"])
    n, n_queries = rows.agg(F.count("*"), F.count_if("is_query")).first()
    sample = _sample(rows, n)
    axes = {dim: turn(x) for dim, (_, x) in sample.items() if 0 < dim <= TURNED}
    blocks = max(1, -(-n_queries // QUERY_ROWS))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "ints"), F.lit(blocks)).cast("int"))

    def pack_group(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(_pack(QUERY_ROWS)(iter(table.combine_chunks().to_batches()))))

    # parts are as large as memory allows, but there are some for every core
    parts = max(1, -(-n // PART_ROWS), min(shuffle_partitions(vectors.sparkSession), -(-n // CANDIDATE_ROWS)))
    q = dealt.groupBy("block").applyInArrow(pack_group, _PACKED).mapInArrow(_with_floors(sample, k), f"{_PACKED}, floor binary")
    q = q.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "floor", "dim", "ids", "vectors", "width")
    c = rows.select("vec_id", "ints").mapInArrow(_pack(CANDIDATE_ROWS), _PACKED)
    c = c.select(F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int").alias("part"), F.lit(None).cast("binary").alias("floor"), "dim", "ids", "vectors", "width")
    pairs = c.unionAll(q).repartition(parts, "part").sortWithinPartitions("part", F.col("floor").isNotNull())
    found = pairs.mapInArrow(_search(k, axes), "query_id long, vec_id long, score long").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
