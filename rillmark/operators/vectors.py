"""Exact nearest-vector search."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rillmark.session import materialize

METRICS = ("cosine", "euclid", "dot", "manhattan")
# Vectors of a block, and blocks of either side that meet in a cell.
BLOCK, CELL = 256, 64


def label_centroids(df: DataFrame, label: str, vector: str, dimension: int) -> DataFrame:
    """Mean vector per label, one aggregate per component."""
    means = F.array(*[F.avg(F.col(vector)[i].cast("double")) for i in range(dimension)])
    return df.groupBy(label).agg(means.alias(vector))


def _distances(metric: str, base, query):
    """(base rows x query rows) matrix; smaller is nearer for every metric but ``dot``."""
    import numpy as np

    if metric == "manhattan":
        return np.stack([np.abs(base - q).sum(axis=1) for q in query], axis=1)
    dots = base @ query.T
    if metric == "dot":
        return dots
    base2, query2 = (base * base).sum(axis=1), (query * query).sum(axis=1)
    if metric == "cosine":
        scale = np.sqrt(base2)[:, None] * np.sqrt(query2)[None, :]
        return 1.0 - np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0)
    return np.stack([np.sqrt(((base - q) ** 2).sum(axis=1)) for q in query], axis=1)


def _packed(df: DataFrame, ident: str, vector: str, block: int) -> DataFrame:
    """Written table of blocks of at most ``block`` vectors: ``number``, ``ids``, ``data`` (doubles), ``size`` of a vector."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                values = part.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)), pa.array([values.tobytes()], pa.binary()),
                     pa.array([len(values) // part.num_rows], pa.int32())], names=["ids", "data", "size"])

    kind = df.schema[ident].dataType.simpleString()
    blocks = df.select(ident, vector).mapInArrow(pack, f"ids array<{kind}>, data binary, size int")
    return materialize(blocks.withColumn("number", F.monotonically_increasing_id()), "vectors")


def _partial_top(metric: str, k: int, ident_type: pa.DataType, query_type: pa.DataType):
    """The k nearest vectors of every query of a block among the base blocks that a task meets it with."""
    sign = -1.0 if metric == "dot" else 1.0

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: dict[int, tuple] = {}
        cell = None

        def send():
            for names, far, ids in held.values():
                kept = far.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(names, kept).tolist(), query_type), pa.array(ids.ravel().tolist(), ident_type), pa.array(sign * far.ravel())],
                    names=["query", "ident", "distance"])
            held.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if row["cell"] != cell:
                    yield from send()
                    cell = row["cell"]
                base, query = (np.frombuffer(row[c]).reshape(-1, row["size"]) for c in ("data", "query_data"))
                far = sign * _distances(metric, base, query).T
                ids = np.broadcast_to(np.array(row["ids"]), far.shape)
                before = held.get(row["query_number"])
                if before is not None:
                    far, ids = np.hstack([before[1], far]), np.hstack([before[2], ids])
                order = np.lexsort((ids, far), axis=1)[:, :k]
                held[row["query_number"]] = np.array(row["query_ids"]), np.take_along_axis(far, order, 1), np.take_along_axis(ids, order, 1)
        yield from send()

    return scan


def nearest(
    base: DataFrame, ident: str, vector: str, queries: DataFrame, query_id: str, metric: str = "cosine", k: int = 3,
    block: int = BLOCK,
) -> DataFrame:
    """The k nearest vectors of ``base`` for every query vector: ``query``, ``ident``, ``distance``, ``rank``.

    Both tables are packed into blocks of ``block`` vectors, and blocks are
    dealt to the cells of a grid: a base block goes to the cells of its row, a
    query block to those of its column, so every pair of blocks meets in one
    cell.  A cell is a matrix product per pair and keeps k rows per query.
    Neither side passes the driver, and no (vector, query) pair is ever a row.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    left, right = _packed(base, ident, vector, block), _packed(queries, query_id, vector, block)
    rows, columns = (max(1, -(-side.count() // CELL)) for side in (left, right))

    def dealt(side: DataFrame, own: int, other: int, first: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("number"), F.lit(own))
        every = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        marked = side.withColumn("_mine", mine).withColumn("_every", every)
        cell = F.col("_mine") * other + F.col("_every") if first else F.col("_every") * own + F.col("_mine")
        return marked.withColumn("cell", cell.cast("long"))

    pairs = dealt(left, rows, columns, True).select("cell", "ids", "data", "size").join(
        dealt(right, columns, rows, False).select(
            "cell", F.col("ids").alias("query_ids"), F.col("data").alias("query_data"), F.col("number").alias("query_number")), "cell")
    name, key = base.schema[ident].dataType, queries.schema[query_id].dataType
    scan = _partial_top(metric, k, to_arrow_type(name), to_arrow_type(key))
    found = pairs.sortWithinPartitions("cell").mapInArrow(scan, f"query {key.simpleString()}, ident {name.simpleString()}, distance double")
    nearest_first = Window.partitionBy("query").orderBy(F.col("distance") * (-1.0 if metric == "dot" else 1.0), "ident")
    top = found.withColumn("rank", F.row_number().over(nearest_first)).filter(F.col("rank") <= k)
    return top.select("query", F.col("ident").alias(ident), "distance", "rank")


def within(matches: DataFrame, maxdistance: float = 0.8) -> DataFrame:
    """Matches not farther than the cut."""
    return matches.filter(F.col("distance") <= maxdistance)
