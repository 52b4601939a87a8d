"""Approximate nearest neighbours with an inverted multi-index, by inner product.

Each vector's two halves are quantised separately, to the nearest of some centroids that k-means fits to a
sample of at most ``SAMPLE`` rows (the first by a hash of their id); the pair of centroids is the vector's cell.
There are about ``CELL`` vectors to a cell, so the number of centroids grows with the root of the number of
rows, up to ``CENTROIDS``. A query walks the cells in order of the summed inner product of its halves with
the centroid pair, taken from a heap, until the cells hold enough vectors. How many that takes is measured:
for at most ``PROBES`` queries (the first by a hash) all rows are ranked, and the share of the walk that
reaches ``REACH`` of their neighbours is taken for all queries. Vectors without structure, as in the test
tables, need a large share. All vectors of the visited cells are scored in double precision and ranked.

Cells are packed into blocks of about ``BLOCK`` vectors, and a large cell is spread over several blocks. A
query is sent to the blocks that it visits, with its cells in them; a task holds one block's vectors and
reads its queries as they come, so neither the index nor the queries are copied or gathered whole. Each
block returns a query's best ``k``; the last step ranks these. Every row is indexed.

Edge cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite
components take no part, neither as queries nor as candidates; rows with a null id take no part; a
repeated id is a candidate as often as it occurs, but never for the query of the same id, and queries with the smallest of its vectors; ties go to the
smaller id; with fewer than ``k`` candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.llm.common import written

CENTROIDS, SAMPLE, CELL = 256, 8_192, 16
PROBES, REACH = 128, 0.95
BLOCK = 4_096


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``id, vector`` of the rows that take part, apart from their length."""
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col(id_column).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(F.col(id_column).cast("long").alias("id"), v.alias("vector"))


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids; the first ones are spread over the rows, an empty one stays where it was."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c**2).sum(1)[None, :] - 2 * x @ c.T, axis=1)


def walk(a: np.ndarray, b: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells (first half's centroid times the second's number, plus the second's) in falling order of ``a[i] + b[j]``."""
    by_a, by_b = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    heap, seen, cells, found = [(-(a[by_a[0]] + b[by_b[0]]), 0, 0)], {(0, 0)}, [], 0
    while heap and found < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(by_a[i]) * len(b) + int(by_b[j])
        if counts[cell]:
            cells.append(cell)
            found += counts[cell]
        for p in ((i + 1, j), (i, j + 1)):
            if p[0] < len(a) and p[1] < len(b) and p not in seen:
                seen.add(p)
                heapq.heappush(heap, (-(a[by_a[p[0]]] + b[by_b[p[1]]]), *p))
    return cells


def pack(counts: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell."""
    first, many, now, filled = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for cell, n in enumerate(counts):
        if filled and filled + n > block:
            now, filled = now + 1, 0
        first[cell], many[cell] = now, max(1, -(-int(n) // block))
        if n > block:
            now, filled = now + many[cell], 0
        else:
            filled += n
    return first, many


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _best(qid: np.ndarray, q: np.ndarray, visited: list[np.ndarray], ids: np.ndarray, x: np.ndarray, cell: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The best ``k`` rows of one block, sorted by cell, for each of its queries over the cells that the query visits."""
    cells, begin = np.unique(cell, return_index=True)
    begin = np.append(begin, len(cell))
    for at in range(0, len(qid), 512):
        part = slice(at, at + 512)
        own, own_id = q[part], qid[part]
        visits = np.zeros((len(own), len(cells)), bool)
        for i, here in enumerate(visited[part]):
            visits[i, np.searchsorted(cells, here[np.isin(here, cells)])] = True
        score = np.full((len(own), len(ids)), -np.inf)
        for c in range(len(cells)):
            who = np.flatnonzero(visits[:, c])
            score[who, begin[c] : begin[c + 1]] = own[who] @ x[begin[c] : begin[c + 1]].T
        score[own_id[:, None] == ids[None, :]] = -np.inf
        n = min(k, len(ids))
        kth = np.partition(score, len(ids) - n, axis=1)[:, len(ids) - n]
        out = []
        for i in range(len(own)):
            near = np.flatnonzero((score[i] >= kth[i] - 1e-9) & np.isfinite(score[i]))
            exact = (x[near] * own[i]).sum(1)  # the same for equal vectors, wherever they stand
            order = np.lexsort((ids[near], -exact))[:k]
            out.append((np.full(len(order), own_id[i]), ids[near[order]], exact[order]))
        yield pa.record_batch([pa.array(np.concatenate([o[j] for o in out])) for j in range(3)], names=["query_id", "vec_id", "score"])


def _meet(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, in each block vectors before queries: hold a block's vectors and let its queries pass."""
    block, held = None, []
    rows = None
    for b in batches:
        blocks, is_query = b.column("block").to_numpy(), b.column("is_query").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.append(True, (blocks[1:] != blocks[:-1]) | (is_query[1:] != is_query[:-1]))) if len(blocks) else []
        for first, last in zip(cuts, np.append(cuts[1:], len(blocks)), strict=True):
            part = b.slice(first, last - first)
            if blocks[first] != block:
                block, held, rows = blocks[first], [], None
            if not is_query[first]:
                held.append(part)
                continue
            if not held:
                continue
            if rows is None:
                t = pa.Table.from_batches(held).sort_by("cell")
                rows = t.column("id").to_numpy(), _matrix(t.column("vector").combine_chunks()), t.column("cell").to_numpy()
            lists = part.column("cells")
            offsets, cells = np.asarray(lists.offsets), lists.values.to_numpy()
            yield from _best(part.column("id").to_numpy(), _matrix(part.column("vector")), [cells[offsets[i] : offsets[i + 1]] for i in range(len(part))], *rows, k)


def _enough(index: DataFrame, queries: DataFrame, books: tuple[np.ndarray, np.ndarray], counts: np.ndarray, k: int, probes: int, reach: float) -> int:
    """How many vectors a walk has to pass so that ``reach`` of the probes' true neighbours are among them."""
    few = queries.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(probes).toPandas()
    if not len(few):
        return 0
    qid, q = few["id"].to_numpy(), np.stack(few["vector"].to_numpy())

    def nearest_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, cell, x = b.column("id").to_numpy(), b.column("cell").to_numpy(), _matrix(b.column("vector"))
            if not len(ids):
                continue
            score = q @ x.T
            score[qid[:, None] == ids[None, :]] = -np.inf
            n = min(k, len(ids))
            top = np.argpartition(-score, n - 1, axis=1)[:, :n].ravel()
            who = np.repeat(np.arange(len(qid)), n)
            yield pa.record_batch([pa.array(who), pa.array(cell[top]), pa.array(score[who, top])], names=["probe", "cell", "score"])

    found = index.mapInArrow(nearest_in, "probe long, cell int, score double").where("score > double('-infinity')")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score")))
    true = found.withColumn("rank", rank).where(F.col("rank") <= k).toPandas()  # PROBES times k rows
    half = books[0].shape[1]
    passed = []
    for i, own in true.groupby("probe"):
        order = np.argsort(-(books[0] @ q[i, :half])[:, None] - (books[1] @ q[i, half:])[None, :], axis=None, kind="stable")
        until = np.empty(len(order), np.int64)
        until[order] = np.cumsum(counts[order])
        passed.append(until[own["cell"].to_numpy()])
    return int(np.quantile(np.concatenate(passed), reach)) if passed else 0


def search(vectors: DataFrame, is_query, k: int = 20, probes: int = PROBES, reach: float = REACH) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors (id, vector)`` where ``is_query`` holds."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    few = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    if not len(few):
        return spark.createDataFrame([], schema)
    dim = int(few["vector"].map(len).mode()[0])
    x = np.stack(few["vector"][few["vector"].map(len) == dim].to_numpy())
    half = dim // 2
    vectors = vectors.where(F.size("vector") == dim)
    centroids = int(np.clip(np.sqrt(vectors.count() / CELL), 4, CENTROIDS))
    books = (k_means(x[:, :half], centroids), k_means(x[:, half:], centroids))
    width = len(books[1])

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("vector"))
            cell = nearest(m[:, :half], books[0]) * width + nearest(m[:, half:], books[1]) if len(m) else np.zeros(0, np.int64)
            yield pa.record_batch([*b.columns, pa.array(cell.astype(np.int32))], names=[*b.schema.names, "cell"])

    index = written(vectors.mapInArrow(to_cells, "id long, vector array<double>, cell int"), "imi-index")
    counts = np.zeros(len(books[0]) * width, np.int64)
    for r in index.groupBy("cell").count().collect():  # one row per cell
        counts[r.cell] = r["count"]
    first, many = pack(counts)
    queries = written(index.where(is_query(F.col("id"))).groupBy("id").agg(F.min("vector").alias("vector")), "imi-queries")
    enough = _enough(index, queries, books, counts, k, probes, reach)

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("vector"))
            for i in range(len(m)):
                cells = np.array(walk(books[0] @ m[i, :half], books[1] @ m[i, half:], counts, enough))
                block = np.concatenate([np.arange(first[c], first[c] + many[c]) for c in cells])
                own = np.repeat(cells, many[cells])
                order = np.lexsort((own, block))
                block, own = block[order], own[order]
                at = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(own)).astype(np.int32)), pa.array(own.astype(np.int32)))
                copies = pa.array(np.full(len(at), i))
                yield pa.record_batch([b.column("id").take(copies), b.column("vector").take(copies), pa.array(block[at]), lists], names=["id", "vector", "block", "cells"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = queries.select("id", "vector").repartition(tasks).mapInArrow(to_blocks, "id long, vector array<double>, block long, cells array<int>")
    packed = spark.createDataFrame([(c, int(first[c]), int(many[c])) for c in np.flatnonzero(counts).tolist()], "cell int, first long, many long")
    block = F.col("first") + F.pmod(F.xxhash64("id", F.lit(7)), F.col("many"))
    rows = index.join(F.broadcast(packed), "cell").withColumn("block", block)  # a row per cell: at most CENTROIDS squared
    both = rows.select("block", F.lit(False).alias("is_query"), "id", "vector", "cell", F.lit(None).cast("array<int>").alias("cells"))
    both = both.union(sent.select("block", F.lit(True), "id", "vector", F.lit(None).cast("int"), "cells"))
    dealt = both.repartition(F.col("block")).sortWithinPartitions("block", "is_query")
    near = dealt.mapInArrow(lambda batches: _meet(batches, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_inverted_multi_index(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for each row whose ``vec_id`` is divisible by 20."""
    return search(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), lambda i: i % 20 == 0)
