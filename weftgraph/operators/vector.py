"""Exact nearest neighbours of vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id long, vector array<float>"
#: Vectors that are compared with a block of queries at a time.
STEP = 256


def distance(v: Column, query: list[float], metric: str = "l2") -> Column:
    """Squared L2, or 1 - cosine (1 for a vector of zeros)."""
    q = F.lit([float(np.float32(x)) for x in query])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    d = F.transform(v, lambda x: x.cast("double"))
    if metric.lower() != "cosine":
        return total(F.zip_with(d, q, lambda a, b: (a - b) * (a - b)))
    norm = F.sqrt(total(F.transform(d, lambda x: x * x))) * float(np.sqrt(sum(float(np.float32(x)) ** 2 for x in query)))
    return F.when(norm == 0, 1.0).otherwise(1 - total(F.zip_with(d, q, lambda a, b: a * b)) / norm)


def nearest(vectors: DataFrame, query: list[float], k: int = 10, metric: str = "l2") -> DataFrame:
    """id, distance of the ``k`` nearest of ``vectors`` (id, vector); ties by id. A top-k in every task, then of these."""
    return vectors.select("id", distance(F.col("vector"), query, metric).alias("distance")).orderBy("distance", "id").limit(k)


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", block: int = 1024) -> DataFrame:
    """query_id, id, distance, rank: the ``k`` nearest of every query vector (id, vector).

    Queries go to the scan in blocks of bounded size; each task keeps its own ``k`` for each query and only these are shuffled.
    """
    from pyspark.sql import Window

    out = None
    n = queries.count()
    blocks = max(1, -(-n // block))
    for i in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect()
        if not part:
            continue
        ids = np.array([r["id"] for r in part], np.int64)
        q = np.array([r["vector"] for r in part], np.float64)

        def search(batches, ids=ids, q=q):
            import pyarrow as pa

            best_d = np.full((len(q), 0), np.inf)
            best_i = np.zeros((len(q), 0), np.int64)
            norm_q = np.linalg.norm(q, axis=1)
            for batch in batches:
                lists, every = batch.column(1), batch.column(0).to_numpy()
                for at in range(0, batch.num_rows, STEP):
                    part = lists.slice(at, STEP)
                    v = part.flatten().to_numpy().astype(np.float64).reshape(len(part), -1)
                    i = every[at : at + STEP]
                    if metric.lower() == "cosine":
                        norms = norm_q[:, None] * np.linalg.norm(v, axis=1)[None]
                        d = np.where(norms == 0, 1.0, 1 - (q @ v.T) / np.where(norms == 0, 1, norms))
                    else:
                        d = np.empty((len(q), len(v)))
                        for j, x in enumerate(q):  # exact differences: products would lose the digits of near vectors
                            d[j] = np.square(v - x).sum(1)
                    d = np.concatenate([best_d, d], 1)
                    i = np.concatenate([best_i, np.broadcast_to(i, (len(q), len(v)))], 1)
                    if d.shape[1] > k:
                        # all that is as near as the k-th, then the first k of these by distance and id
                        limit = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                        order = np.lexsort((np.where(d <= limit, i, np.iinfo(np.int64).max), np.where(d <= limit, d, np.inf)))[:, :k]
                    else:
                        order = np.lexsort((i, d))
                    best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
            if best_d.shape[1]:
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(ids, best_d.shape[1])), "id": pa.array(best_i.ravel()), "distance": pa.array(best_d.ravel())})

        found = vectors.select(F.col("id").cast("bigint"), "vector").mapInArrow(search, "query_id long, id long, distance double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id long, id long, distance double")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).filter(F.col("rank") <= k)


class VectorIndex:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.build(0)

    def build(self, dim: int, metric: str = "l2") -> str:
        self.dim, self.metric, self.staged = dim, "cosine" if metric.lower() == "cosine" else "l2", []
        self.vectors = self.spark.createDataFrame([], SCHEMA)
        return f"built dim={dim} metric={self.metric}"

    def add(self, id: int, vector: list[float]) -> str:
        if self.dim and len(vector) != self.dim:
            raise ValueError(f"a vector of {self.dim} numbers is needed, not {len(vector)}")
        self.staged.append((int(id), [float(x) for x in vector]))
        return "ok"

    def use(self, vectors: DataFrame) -> None:
        """Search ``vectors`` (id, vector)."""
        self.vectors = vectors.select(F.col("id").cast("bigint"), F.col("vector").cast("array<float>").alias("vector"))

    def all(self) -> DataFrame:
        if self.staged:
            self.vectors = self.vectors.unionByName(self.spark.createDataFrame(self.staged, SCHEMA))
            self.staged = []
        return self.vectors


def _numbers(x) -> list[float]:
    return [float(v) for v in (x.split(",") if isinstance(x, str) else x)]


def register(session) -> None:
    one = lambda s, v: s.spark.range(1).select(F.lit(v).alias("status"))
    session.register_procedure("vector.build", lambda s, dim, metric="l2": one(s, s.vectors.build(int(dim), str(metric))))
    session.register_procedure("vector.add", lambda s, id, v: one(s, s.vectors.add(int(id), _numbers(v))))
    session.register_procedure("vector.search", lambda s, v, k=10: nearest(s.vectors.all(), _numbers(v), int(k), s.vectors.metric))
