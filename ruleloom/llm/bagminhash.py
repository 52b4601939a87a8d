"""Near-duplicate documents by weighted MinHash over word shingles.

A document is the multiset of its runs of ``SHINGLE`` words (lower-cased; of fewer words: all of them as
one run). Its signature is BagMinHash: every shingle owns a Poisson process in time over its weight. The
weights are discretised to counts and arranged in octaves [0,1), [1,2), [2,4), [4,8), ...; an octave of
width w has one process of rate w whose points carry a level inside the octave, and a document of count c
sees the points below level c. So two documents see the same points up to the smaller count, which makes
the probability that a signature component agrees equal to the weighted Jaccard similarity. Each point
falls in one of the components and the earliest one counts; points are made only up to a time by which
the components are filled, and longer for the few documents where they are not.

Signatures are cut into ``BANDS`` bands of ``ROWS`` components. Documents of equal multisets are one node;
nodes that share a band are candidates, which are verified by the exact overlap of their multisets, and
linked nodes form classes (module ``links``).

Edge cases: null, empty and wordless texts are classes of their own; repeated rows are copies; null ids
are kept, and the class id is the smallest id of its class that is not null (null if it has none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import written
from ruleloom.llm.links import link
from ruleloom.llm.textops import Slice, grams, inside, mix, seeded, slices

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4  # misses a pair at the threshold once in 37,000
BROADCAST_ROWS = 200_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and document numbers of a slice, in order."""
    low = piece.lowered()
    starts, ends, docs = low.words("alnum")
    h = low.hashes(starts, ends)
    g, ok = grams(h, SHINGLE), inside(docs, SHINGLE)
    out, of = [g[ok]], [docs[: len(g)][ok]]
    counts = np.bincount(docs, minlength=piece.n)
    first = np.cumsum(counts) - counts
    for n in range(1, SHINGLE):
        short = np.flatnonzero(counts == n)
        if len(short):
            out.append(grams(h, n)[first[short]])
            of.append(short)
    return np.concatenate(out), np.concatenate(of)


def multiset(h: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, document) pairs with their counts."""
    key = mix(h ^ seeded(docs.astype(np.uint64), 11))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return h[order][first], docs[order][first], np.diff(np.append(first, len(key)))


def signatures(h: np.ndarray, docs: np.ndarray, count: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """One row of ``m`` earliest times per document; infinite where a document has no shingle."""
    out = np.full(n_docs * m, np.inf)
    octave = np.zeros(len(h), np.int64)
    rows = [(np.arange(len(h)), octave)]
    width = 1
    while True:
        more = np.flatnonzero(count > width)  # the octave [width, 2 width) holds part of the weight
        if not len(more):
            break
        rows.append((more, np.full(len(more), width)))
        width *= 2
    of = np.concatenate([r[0] for r in rows])
    low = np.concatenate([r[1] for r in rows])
    wide = np.maximum(low, 1).astype(np.float64)
    seed, doc, limit = seeded(h[of], 1) + mix(low.astype(np.uint64)), docs[of], count[of]
    total = np.maximum(np.bincount(docs, count, minlength=n_docs), 1)
    until = m * (np.log(m) + 6) / total
    todo = np.arange(len(of))
    while len(todo):
        x, j, live = np.zeros(len(todo)), 0, todo
        while len(live):
            block = int(np.clip(200_000 // len(live), 1, 512))
            r = mix(seed[live][:, None] + np.arange(j + 1, j + 1 + block, dtype=np.uint64)[None, :] * _STEP)
            times = x[:, None] + np.cumsum(-np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / wide[live][:, None], axis=1)
            r = mix(r ^ _STEP)
            level = low[live][:, None] + (r >> np.uint64(32)).astype(np.float64) * 2.0**-32 * wide[live][:, None]
            seen = (times <= until[doc[live]][:, None]) & (level < limit[live][:, None])
            at = (doc[live][:, None] * m + ((r & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64))[seen]
            np.minimum.at(out, at, times[seen])
            x = times[:, -1]
            on = x <= until[doc[live]]
            x, live, j = x[on], live[on], j + block
        empty = np.isinf(out.reshape(n_docs, m)).any(1)
        todo = todo[empty[doc[todo]]]
        until = until * 4
    return out.reshape(n_docs, m)


def bands(signature: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """One hash per document and band."""
    bits = signature.view(np.uint64).reshape(len(signature), n_bands, rows)
    out = np.broadcast_to(np.arange(1, n_bands + 1, dtype=np.uint64)[None, :], bits.shape[:2]).copy()
    for r in range(rows):
        out = mix(out * _STEP + bits[:, :, r])
    return out


def _lists(values: np.ndarray, width: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))


def sketches(documents: DataFrame) -> DataFrame:
    """``doc_id, text_hash, node, size, bands`` of each row; without words the node is null."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b.column("text")):
                h, docs, count = multiset(*shingles(piece))
                size = np.bincount(docs, count, minlength=piece.n).astype(np.int64)
                node = np.zeros(piece.n, np.uint64)
                np.add.at(node, docs, mix(h + mix(count.astype(np.uint64))))
                node = mix(node + size.astype(np.uint64)).view(np.int64)
                sig = bands(signatures(h, docs, count, piece.n, BANDS * ROWS), BANDS, ROWS)
                part = b.slice(piece.first, piece.n)
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(node, mask=size == 0), pa.array(size), _lists(sig, BANDS)],
                    names=["doc_id", "text_hash", "node", "size", "bands"],
                )

    id_type = documents.schema["doc_id"].dataType.simpleString()
    source = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return source.mapInArrow(rows, f"doc_id {id_type}, text_hash long, node long, size long, bands array<long>")


def item_sets(texts: DataFrame) -> DataFrame:
    """``node, items``: the n-th occurrence of a shingle is an item of its own, so sets stand for multisets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b.column("text")):
                h, docs, count = multiset(*shingles(piece))
                order = np.argsort(docs, kind="stable")
                h, docs, count = h[order], docs[order], count[order]
                nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                items = mix(np.repeat(h, count) + mix(nth.astype(np.uint64)))
                cut = np.searchsorted(np.repeat(docs, count), np.arange(piece.n + 1)).astype(np.int32)
                yield pa.record_batch([b.column("node").slice(piece.first, piece.n), pa.ListArray.from_arrays(pa.array(cut), pa.array(items.view(np.int64)))], names=["node", "items"])

    return texts.select("node", "text").mapInArrow(rows, "node long, items array<long>")


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, text_hash, class_id, class_size, n_shingles, kept``.

    Of each class the row of the smallest id (null ids last) is kept.
    """
    documents = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = written(sketches(documents).withColumn("row", F.monotonically_increasing_id()), "bag-rows")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min_by(F.struct("doc_id", "text_hash", "size", "bands"), "row").alias("x"))
    entries = nodes.select("node", "x.size", F.explode("x.bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    entries = written(entries.join(shared, "bucket", "left_semi"), "bag-entries")
    wanted = nodes.join(entries.select("node").distinct(), "node", "left_semi").select("node", F.col("x.doc_id").alias("__id"), F.col("x.text_hash").alias("__hash"))
    wanted = written(wanted, "bag-wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__hash"))
    texts = documents.join(wanted, same).select("node", "text")
    sets = written(item_sets(texts).dropDuplicates(["node"]), "bag-sets")
    linked = link(entries, sets, threshold, "bag")
    found = rows.join(linked, "node", "left").select(
        "doc_id", "text_hash", "size", "row", F.coalesce("component", "node").alias("component"), F.when(F.col("node").isNull(), F.col("row")).alias("alone")
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = found.groupBy("component", "alone").agg(first.alias("first"), F.count("*").alias("class_size"))
    named = classes.withColumnsRenamed({"component": "__c", "alone": "__a"})
    same = F.col("component").eqNullSafe(F.col("__c")) & F.col("alone").eqNullSafe(F.col("__a"))
    return found.join(named, same).select(
        "doc_id", "text_hash", F.col("first.doc_id").alias("class_id"), "class_size", F.col("size").alias("n_shingles"), (F.col("row") == F.col("first.row")).alias("kept")
    )


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """One document of each class, with all its columns; of rows that are equal in id and text one stays."""
    kept = near_duplicates(documents).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col("__hash"))
    one = documents.dropDuplicates(["doc_id", "text"]) if documents.groupBy("doc_id").count().where("count > 1").take(1) else documents
    return one.join(kept, same, "left_semi")


def op4_bagminhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the id of its class (the smallest ``doc_id`` in it) and whether it stays."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")
