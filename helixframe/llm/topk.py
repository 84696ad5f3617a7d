"""Exact top-k search by inner product: columnar branch and bound.

Vectors are quantised and packed into blocks in vertical layout: one row of a block's matrix holds one dimension of all its
vectors.  A block pair accumulates scores dimension block by dimension block.  After each, a candidate's score is at most
its sum so far plus the product of the lengths that remain (Cauchy-Schwarz); candidates below the query's k-th best score so
far are dropped and the survivors compacted.  Each query starts with the k-th best score within its own block.

The queries are a stated set and meet all rows in blocks: query blocks are dealt over ``groups`` and candidate blocks belong
to one of them, so the join is an equi-join of packed blocks.  Only a query's best k of each block pair leave a task.

Vectors that are null, empty or hold null or non-finite components take no part, nor do rows with a null id.  A vector meets only
vectors of its own dimension.  Each row is a candidate for every query but itself, also where ids or vectors repeat; a query row that
repeats gives its own rows.  Equal scores rank by the smaller id, whatever their sign.  Scores are exact wherever they fit a long; a component
outside a long after scaling counts as the long's end, as does a score.  An empty table, or one without queries, gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, stored

BLOCK_ROWS, QUERY_ROWS, STEP = 4096, 256, 16
_PACKED = "block long, dim int, n int, ids binary, cells binary"
_QUERIES = _PACKED + ", places binary, floors binary"
_QUERY_NAMES = [field.split()[0] for field in _QUERIES.split(", ")]


def _pack(rows: int):
    """Arrow function: (dim, id, integer components) rows into blocks; the block number is unique by partition and order."""

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def block(dim, ids, cells):
            nonlocal made
            made += 1
            small = cells.min(initial=0) >= -(1 << 31) and cells.max(initial=0) < 1 << 31
            vertical = np.ascontiguousarray(cells.T, dtype=np.int32 if small else np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + made]), pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([vertical.tobytes()], pa.binary())],
                names=["block", "dim", "n", "ids", "cells"],
            )

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes, flat, at = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), 0
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes):
                pick = np.flatnonzero(sizes == dim)
                cells = flat[starts[pick][:, None] + np.arange(dim)]
                held.setdefault(int(dim), []).append((ids[pick].astype(np.int64), cells.astype(np.int64)))
                if sum(len(x[0]) for x in held[int(dim)]) >= rows:
                    ids_, cells_ = (np.concatenate(x) for x in zip(*held.pop(int(dim)), strict=True))
                    for at in range(0, len(ids_), rows):
                        yield block(int(dim), ids_[at : at + rows], cells_[at : at + rows])
        for dim, parts in held.items():
            ids_, cells_ = (np.concatenate(x) for x in zip(*parts, strict=True))
            for at in range(0, len(ids_), rows):
                yield block(dim, ids_[at : at + rows], cells_[at : at + rows])

    return run


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the lesser id, best first."""
    return np.lexsort((ids, -scores))[:k]


def _exact(queries: np.ndarray, cells: np.ndarray) -> bool:
    """Whether float64 sums of products are exact."""
    top = float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(cells.astype(np.float64)).max(initial=0))
    return top * max(len(cells), 1) < 2**52


def _floor(score: int) -> float:
    """A double of at most the score."""
    near = float(score)
    return near if int(near) <= score else float(np.nextafter(near, -np.inf))


def _tails(x: np.ndarray, steps: list[int]) -> np.ndarray:
    """Lengths of the components from each step on, rounded up: (steps, vectors)."""
    square = x.astype(np.float64) ** 2
    return np.sqrt(np.stack([square[s:].sum(0) for s in steps])) * (1 + 1e-9)


def block_best(queries: np.ndarray, cells: np.ndarray, ids: np.ndarray, floors: np.ndarray, own: np.ndarray, k: int):
    """Per query (columns of queries) the places and scores of its best k candidates with scores of at least its floor.

    own: the query's own column in cells, -1 elsewhere.
    """
    dim = len(cells)
    if not _exact(queries, cells):
        q, c = queries.astype(object), cells.astype(object)
        for j in range(queries.shape[1]):
            scores = np.array([int(v) for v in q[:, j] @ c], dtype=object)
            keep = [i for i in range(len(ids)) if i != own[j] and scores[i] >= floors[j]]
            keep.sort(key=lambda i: (-scores[i], ids[i]))
            yield j, np.array(keep[:k], np.int64), np.array([max(-(2**63), min(2**63 - 1, scores[i])) for i in keep[:k]], np.int64)
        return
    q, c = queries.astype(np.float64), cells.astype(np.float64)
    steps = list(range(0, dim, STEP)) or [0]
    q_tail, c_tail = _tails(queries, [*steps[1:], dim]), _tails(cells, [*steps[1:], dim])
    first = q[: STEP].T @ c[: STEP]  # the first dimension block of all pairs at once
    limit = first + q_tail[0][:, None] * c_tail[0] + 1e-6
    for j in range(q.shape[1]):
        floor = floors[j]
        alive = np.flatnonzero(limit[j] >= floor)
        alive = alive[alive != own[j]]
        sums = first[j, alive]
        for s, at in enumerate(steps[1:], 1):
            sums = sums + q[at : at + STEP, j] @ c[at : at + STEP, alive]
            if len(alive) > k:
                low = np.partition(sums - q_tail[s, j] * c_tail[s, alive], len(alive) - k)[len(alive) - k]  # k candidates reach this at least
                floor = max(floor, low - 1e-6)
            keep = sums + q_tail[s, j] * c_tail[s, alive] + 1e-6 >= floor
            if not keep.all():
                alive, sums = alive[keep], sums[keep]
        keep = sums >= floors[j]
        alive, sums = alive[keep], sums[keep]
        top = _best(ids[alive], sums, k)
        yield j, alive[top], sums[top].astype(np.int64)


def _open(ids, cells, dim, n):
    kind = np.int64 if len(cells) == 8 * dim * n else np.int32
    return np.frombuffer(ids, np.int64), np.frombuffer(cells, kind).reshape(dim, n)


def top_k(rows: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, groups: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each row for which is_query holds.

    Components count as floor(scale * component), the component as double.  is_query: a Column over id_col.  groups: into how many
    parts the candidates are dealt, by default the shuffle partitions.
    """
    spark = rows.sparkSession
    groups = groups or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    sound = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    usable = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col)).where(sound)
    packed = stored(arrow_map(usable.select("id", cells.alias("v")), _pack(BLOCK_ROWS), _PACKED), "blocks")

    return _search(packed, is_query, id_col, k, groups)


def _search(packed: DataFrame, is_query, id_col: str, k: int, groups: int) -> DataFrame:
    # Queries leave the packed blocks as blocks of their own that know where each query stands; their floor is the k-th best
    # score within the block.  Which ids are queries is decided by Spark on the ids alone, then carried to the blocks as a bit for each place.
    ids = arrow_map(packed.select("block", "n", "ids"), _unpack_ids, "block long, place int, id long")
    marks = ids.select("block", "place", F.col("id").alias(id_col)).where(is_query).groupBy("block").agg(F.sort_array(F.collect_list("place")).alias("at"))

    def cut(batches):
        for batch in batches:
            for r in batch.to_pylist():
                own, x = _open(r["ids"], r["cells"], r["dim"], r["n"])
                at = np.array(r["at"], np.int64)
                for i in range(0, len(at), QUERY_ROWS):
                    pick = at[i : i + QUERY_ROWS]
                    floors = np.full(len(pick), -np.inf)
                    for j, _, scores in block_best(x[:, pick], x, own, floors.copy(), pick, k):
                        if len(scores) == k:
                            floors[j] = _floor(int(scores[-1]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["block"]]), pa.array([r["dim"]], pa.int32()), pa.array([len(pick)], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (own[pick], np.ascontiguousarray(x[:, pick]), pick, floors))],
                        names=_QUERY_NAMES,
                    )

    queries = stored(arrow_map(packed.join(marks, "block").select("block", "dim", "n", "ids", "cells", "at"), cut, _QUERIES), "queries")
    dealt = queries.select(*(F.col(c).alias(f"q_{c}") for c in _QUERY_NAMES), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    pairs = packed.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).join(dealt.hint("merge"), (F.col("g") == F.col("group")) & (F.col("dim") == F.col("q_dim")))

    def match(batches):
        names = ["query_block", "query_place", "query_id", "vec_id", "score"]
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                cand, x = _open(r["ids"], r["cells"], r["dim"], r["n"])
                qid, q = _open(r["q_ids"], r["q_cells"], r["dim"], r["q_n"])
                places, floors = np.frombuffer(r["q_places"], np.int64), np.frombuffer(r["q_floors"], np.float64)
                own = places if r["block"] == r["q_block"] else np.full(len(qid), -1)
                out = list(block_best(q, x, cand, floors, own, k))
                who = np.repeat([j for j, _, _ in out], [len(a) for _, a, _ in out]).astype(np.int64)
                at, score = (np.concatenate([o[c] for o in out]).astype(np.int64) for c in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), r["q_block"])), pa.array(places[who]), pa.array(qid[who]), pa.array(cand[at]), pa.array(score)], names=names)

    found = arrow_map(pairs.select("block", "dim", "n", "ids", "cells", "q_block", "q_n", "q_ids", "q_cells", "q_places", "q_floors"), match, "query_block long, query_place long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_block", "query_place").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _unpack_ids(batches):
    for batch in batches:
        for r in batch.to_pylist():
            ids = np.frombuffer(r["ids"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r["block"])), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], names=["block", "place", "id"])
