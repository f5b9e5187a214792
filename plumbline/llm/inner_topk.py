"""Exact top-k inner products over norm-sorted vectors.

Candidates are cut into blocks of falling length.  The longest ones give
every query a first threshold, its k-th score among them.  A block whose
longest vector times the query's length stays under the thresholds of a whole
query block is never read for it (Cauchy-Schwarz).  Where blocks meet, both
sides are rotated so that the leading coordinates hold most of the length
(singular vectors of a bounded sample; any rotation is exact), the product
over those is taken first, and only pairs whose partial sum plus the product
of the remaining lengths reaches the threshold are scored in integers.

Which blocks meet is settled on lengths alone: blocks are told by bands of
length, of which there are few, and a query block asks every band from its
own need upwards, so blocks join on equal bands.  A task holds one query
block and has a run of candidate blocks stream past it, longest first, its
thresholds rising as it goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import keep

K = 5
SCALE = 256
#: Vectors that the rotation is fitted on and that set the first thresholds.
HEAD_ROWS = 4096
#: Vectors of a block, and the bytes that bound it for long vectors.
CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 8192
BLOCK_BYTES = 4 << 20
#: Queries that are scored together.
QUERIES_AT_ONCE = 1024
#: Candidate blocks that one task has stream past a query block.
RUN_BLOCKS = 16
#: Length from which a vector's products may leave 64 bits.
LONGEST = float(1 << 31)
#: Bands of length in a doubling.
BANDS = 8
#: Candidates scored between two looks at the thresholds.
SLICE = 1024
#: Leading share of the rotated coordinates.
LEADING = 0.25

_BLOCK = "block long, longest double, rows binary, ids binary, vectors binary"


def clean_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(row, vec_id, v, norm)`` with ``v`` = floor(256 x) as longs, one for each row that takes part.

    Rows whose id or vector is null or whose vector holds a null or
    non-finite component take no part.  ``row`` numbers rows; write the table
    before it is read twice.
    """
    x = F.col("x")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    scaled = F.transform("x", lambda e: F.floor(e * SCALE))
    return (
        table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
        .where(F.col("vec_id").isNotNull() & x.isNotNull() & finite)
        .select(
            F.monotonically_increasing_id().alias("row"),
            "vec_id",
            scaled.alias("v"),
            F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, e: a + F.pow(F.floor(e * SCALE).cast("double"), F.lit(2.0)))).alias("norm"),
        )
    )


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _block_rows(rows: int, width: int) -> int:
    return max(1, min(rows, BLOCK_BYTES // (8 * width)))


def _blocks(rows_in_block: int, width: int):
    """Packs rows of a partition, in their order, into block rows."""

    def run(batches):
        from pyspark import TaskContext

        first, made, held, norms = TaskContext.get().partitionId() << 32, 0, ([], [], []), []

        def pack():
            rows, ids, vectors = held
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([first + made], pa.int64()),
                    pa.array([max(norms)]),
                    pa.array([np.array(rows, dtype=np.int64).tobytes()], pa.binary()),
                    pa.array([np.array(ids, dtype=np.int64).tobytes()], pa.binary()),
                    pa.array([_matrix(vectors, width).tobytes()], pa.binary()),
                ],
                ["block", "longest", "rows", "ids", "vectors"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                few = batch.slice(at, 256)
                for r, i, v, n in zip(*(c.to_pylist() for c in few.columns), strict=True):
                    for store, value in zip(held, (r, i, v), strict=True):
                        store.append(value)
                    norms.append(n)
                    if len(norms) == rows_in_block:
                        yield pack()
                        made += 1
                        held, norms = ([], [], []), []
        if norms:
            yield pack()

    return run


def top_of_block(
    q_rows: np.ndarray,
    q: np.ndarray,
    c_rows: np.ndarray,
    c_ids: np.ndarray,
    c: np.ndarray,
    rotation: np.ndarray,
    k: int,
    threshold: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, candidate id, score)`` of each query's k best in the block; queries by their place.

    Candidates come longest first; only scores of at least ``threshold``
    count, ties go to the smaller id, and a query's own row is left out.
    """
    lead = max(1, int(q.shape[1] * LEADING))
    qr, cr = q @ rotation, c @ rotation
    q_rest, c_rest = np.linalg.norm(qr[:, lead:], axis=1), np.linalg.norm(cr[:, lead:], axis=1)
    q_norm, c_norm = np.linalg.norm(qr, axis=1), np.linalg.norm(cr, axis=1)
    slack = 1e-6 * (1 + q_norm * (c_norm.max() if len(c_norm) else 0))
    bar = threshold.astype(float)
    best_row, best_id, best_score = (np.empty(0, np.int64) for _ in range(3))
    for at in range(0, len(c_ids), SLICE):
        part = slice(at, at + SLICE)
        live = np.flatnonzero(q_norm * c_norm[part].max() + slack >= bar)
        if not len(live):
            break
        partial = qr[live, :lead] @ cr[part, :lead].T
        partial += np.outer(q_rest[live], c_rest[part])
        keep_ = partial + slack[live, None] >= bar[live, None]
        rows, columns = np.nonzero(keep_ & (q_rows[live, None] != c_rows[part][None, :]))
        if not len(rows):
            continue
        rows, columns = live[rows], columns + at
        score = np.empty(len(rows), np.int64)
        for s in range(0, len(rows), 1 << 16):
            e = slice(s, s + (1 << 16))
            score[e] = np.einsum("ij,ij->i", q[rows[e]], c[columns[e]])
        fine = score >= bar[rows]
        best_row = np.append(best_row, rows[fine])
        best_id = np.append(best_id, c_ids[columns[fine]])
        best_score = np.append(best_score, score[fine])
        order = np.lexsort((best_id, -best_score, best_row))
        best_row, best_id, best_score = best_row[order], best_id[order], best_score[order]
        start = np.flatnonzero(np.append(True, best_row[1:] != best_row[:-1])) if len(best_row) else best_row
        place = np.arange(len(best_row)) - np.repeat(start, np.diff(np.append(start, len(best_row))))
        best_row, best_id, best_score = best_row[place < k], best_id[place < k], best_score[place < k]
        full = place[place < k] == k - 1
        bar[best_row[full]] = np.maximum(bar[best_row[full]], best_score[full])
    return best_row, best_id, best_score


def _kth(rows: np.ndarray, score: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th best of each query's scores, where it has so many, else minus infinity."""
    low = np.full(n, np.inf)
    np.minimum.at(low, rows, score)
    return np.where(np.bincount(rows, minlength=n) >= k, low, -np.inf)


def _unpacked(row, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, ids = (np.frombuffer(row[c], np.int64) for c in ("rows", "ids"))
    return rows, ids, np.frombuffer(row["vectors"], np.int64).reshape(-1, width)


def _rows_of(batches) -> Iterator[dict]:
    """Rows of the batches; a block at a time becomes Python objects."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def _threshold_batches(head, rotation, k, width):
    def run(batches):
        for row in _rows_of(batches):
            q_rows, _, q = _unpacked(row, width)
            bar = np.full(len(q), -np.inf)
            for at in range(0, len(q), QUERIES_AT_ONCE):
                part = slice(at, at + QUERIES_AT_ONCE)
                n = len(q[part])
                found, _, score = top_of_block(q_rows[part], q[part], *head, rotation, k, np.full(n, -np.inf))
                bar[part] = _kth(found, score, n, k)
            norm = np.sqrt((q.astype(float) ** 2).sum(axis=1))
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(bar > 0, bar / norm, -np.inf)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["block"]], pa.int64()),
                    pa.array([max(0.0, float(need.min()) * (1 - 1e-9))]),
                    *(pa.array([row[c]], pa.binary()) for c in ("rows", "ids", "vectors")),
                    pa.array([bar.tobytes()], pa.binary()),
                ],
                ["q_block", "need", "rows", "ids", "vectors", "bars"],
            )

    return run


def _score_batches(rotation, k, width):
    """Rows of a task are query blocks, each before the candidate blocks that stream past it."""

    def run(batches):
        key = q_rows = q_ids = q = bars = None
        for row in _rows_of(batches):
            if row["bars"] is not None:
                key, (q_rows, q_ids, q) = (row["q_block"], row["run"]), _unpacked(row, width)
                bars = np.frombuffer(row["bars"]).copy()
                continue
            assert key == (row["q_block"], row["run"]), "a query block stands before its candidates"
            c_rows, c_ids, c = _unpacked(row, width)
            for at in range(0, len(q), QUERIES_AT_ONCE):
                part = slice(at, at + QUERIES_AT_ONCE)
                n = len(q[part])
                found, ids, score = top_of_block(q_rows[part], q[part], c_rows, c_ids, c, rotation, k, bars[part])
                bars[part] = np.maximum(bars[part], _kth(found, score, n, k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_rows[part][found]), pa.array(q_ids[part][found]), pa.array(ids), pa.array(score)],
                    ["q_row", "query_id", "vec_id", "score"],
                )

    return run


def _band(length):
    """Bands of length, 0 for lengths up to 1; they ascend with it."""
    return F.ceil(BANDS * F.log2(F.greatest(length, F.lit(1.0)))).cast("int")


def top_inner_products(
    table: DataFrame,
    is_query,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best other vectors.

    ``is_query`` is a condition on ``vec_id``.  See :func:`clean_vectors` for
    the rows that take no part.  A row that repeats an id is a candidate of
    its own, and a query of its own with ranks of its own; only the query's
    own row is no candidate of it.  Ties go to the smaller id.  Shorter
    vectors are padded with zeros; other columns, whatever their names, are
    not read.  A query with fewer than k candidates returns them all; an
    empty table gives an empty one.  A vector whose scaled length reaches
    2^31, so that products might leave 64 bits, is refused with an error.
    """
    vectors = keep(clean_vectors(table, id_col, vector_col), "vectors")
    width, longest = vectors.agg(F.max(F.size("v")), F.max("norm")).first()
    width = width or 1
    if longest is not None and longest >= LONGEST:
        raise ValueError(f"a vector's scaled length is {longest:.4g}; scores of 64 bits need less than {LONGEST:.4g}")
    # HEAD_ROWS rows at most reach the driver each time
    top = vectors.orderBy(F.desc("norm"), "vec_id", "row").limit(HEAD_ROWS).collect()
    head = (*(np.array([r[c] for r in top], dtype=np.int64) for c in ("row", "vec_id")), _matrix([r.v for r in top], width))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "row").limit(HEAD_ROWS).collect()
    shape = _matrix([r.v for r in sample], width).astype(float)
    _, rotation = np.linalg.eigh(shape.T @ shape)
    rotation = np.ascontiguousarray(rotation[:, ::-1])

    def by_length(rows: DataFrame) -> DataFrame:
        return rows.repartitionByRange(F.desc("norm")).sortWithinPartitions(F.desc("norm"), "vec_id", "row")

    candidates = keep(
        by_length(vectors).mapInArrow(_blocks(_block_rows(CANDIDATE_BLOCK, width), width), _BLOCK), "candidate-blocks"
    )
    queries = keep(
        by_length(vectors.where(is_query))
        .mapInArrow(_blocks(_block_rows(QUERY_BLOCK, width), width), _BLOCK)
        .mapInArrow(
            _threshold_batches(head, rotation, k, width),
            "q_block long, need double, rows binary, ids binary, vectors binary, bars binary",
        ),
        "query-blocks",
    )
    last_band = int(np.ceil(BANDS * np.log2(LONGEST)))
    asked = queries.select("q_block", "need", F.explode(F.sequence(_band(F.col("need")), F.lit(last_band))).alias("band"))
    lengths = candidates.select("block", "longest", _band(F.col("longest")).alias("band"))
    pairs = keep(
        asked.join(lengths, "band")
        .where("longest >= need")
        .select("q_block", F.shiftright("block", RUN_BLOCKS.bit_length() - 1).alias("run"), "block"),
        "block-pairs",
    )
    held = ["rows", "ids", "vectors"]
    first = pairs.select("q_block", "run").distinct().join(queries.drop("need"), "q_block")
    past = pairs.join(candidates, "block").select("q_block", "run", "block", *held, F.lit(None).cast("binary").alias("bars"))
    stream = (
        first.select("q_block", "run", F.lit(-1).cast("long").alias("block"), *held, "bars")
        .unionByName(past)
        .repartition("q_block", "run")
        .sortWithinPartitions("q_block", "run", "block")
    )
    found = stream.mapInArrow(_score_batches(rotation, k, width), "q_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
