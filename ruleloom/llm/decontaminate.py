"""Benchmark decontamination by winnowing.

Training texts and benchmark items become words; every run of ``WINDOW`` item words is a window. Both
sides keep the minimum hash of ``GRAM`` consecutive words in each window (winnowing): equal windows keep
equal fingerprints, so a shared span of ``WINDOW`` words always shares one. A training fingerprint that
the benchmark has is a hit, and each hit is extended: the windows around it are compared whole. Items of
fewer words than a window are one window each and are looked up at their own length.

A benchmark of at most ``BLOCK_WINDOWS`` windows is an index that travels with the tasks: the join of the
fingerprints is a look-up, and nothing is shuffled. A larger one stays a table: the documents' fingerprints
meet the benchmark's in a join by Spark, those that hit bring the hashes of their windows along, which meet
the benchmark's windows in a second join, and the hits are put together by document. Neither the index nor
the number of passes over the documents grows with the benchmark then.

Edge cases: a null or empty text has no words and no hits; a null ``item_id`` marks words but is not
listed; repeated document rows each get a result of their own; repeated items change nothing; an empty
benchmark leaves every document clean; columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import with_row_numbers, written
from ruleloom.llm.textops import Slice, grams, inside, isin_sorted, slices, sliding_min_positions

WINDOW, GRAM = 10, 5
BLOCK_WINDOWS = 1_000_000

_INDEX_SCHEMA = "item string, length int, fingerprint long, window_hash long"


def _selected(word_hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and the gram that winnowing keeps for each window's start (-1: crosses texts)."""
    g = grams(word_hashes, GRAM)
    n = len(word_hashes) - WINDOW + 1
    if n <= 0:
        return g, np.zeros(0, np.int64)
    return g, np.where(inside(docs, WINDOW), sliding_min_positions(g, WINDOW - GRAM + 1)[:n], -1)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """One row per distinct window of an item: its length in words, kept fingerprint and whole hash."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id").to_pylist()
            for piece in slices(batch.column("text")):
                low = piece.lowered()
                starts, ends, docs = low.words("alnum")
                h = low.hashes(starts, ends)
                counts = np.bincount(docs, minlength=piece.n)
                g, keep = _selected(h, docs)
                at = np.flatnonzero(keep >= 0)
                item, length = [docs[at]], [np.full(len(at), WINDOW)]
                fp, whole = [g[keep[at]]], [grams(h, WINDOW)[at]]
                first = np.cumsum(counts) - counts
                for n in range(1, WINDOW):
                    short = np.flatnonzero(counts == n)
                    x = grams(h, n)[first[short]] if len(short) else np.zeros(0, np.uint64)
                    item.append(short), length.append(np.full(len(short), n)), fp.append(x), whole.append(x)
                yield pa.record_batch(
                    [
                        pa.array([ids[piece.first + i] for i in np.concatenate(item)], pa.string()),
                        pa.array(np.concatenate(length).astype(np.int32)),
                        pa.array(np.concatenate(fp).view(np.int64)),
                        pa.array(np.concatenate(whole).view(np.int64)),
                    ],
                    names=["item", "length", "fingerprint", "window_hash"],
                )

    source = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(rows, _INDEX_SCHEMA).distinct()


class Index:
    """One block of the benchmark: sorted fingerprints and windows, and the items of each window."""

    def __init__(self, rows: list):
        self.items = sorted({r.item for r in rows if r.item is not None})
        number = {x: i for i, x in enumerate(self.items)}
        length = np.array([r.length for r in rows], np.int64)
        fp = np.array([r.fingerprint for r in rows], np.int64).view(np.uint64)
        whole = np.array([r.window_hash for r in rows], np.int64).view(np.uint64)
        item = np.array([number.get(r.item, -1) for r in rows], np.int64)
        self.fingerprints = np.unique(fp[length == WINDOW])
        self.by_length = {}
        for n in np.unique(length):
            of = np.flatnonzero(length == n)
            of = of[np.argsort(whole[of], kind="stable")]
            keys, begin = np.unique(whole[of], return_index=True)
            self.by_length[int(n)] = (keys, np.append(begin, len(of)), item[of])


def _hits(piece: Slice, index: Index) -> tuple[np.ndarray, np.ndarray, list[set[int]]]:
    """Words of each text, the hit words as a mask with document numbers, and the items of each text."""
    low = piece.lowered()
    starts, ends, docs = low.words("alnum")
    h = low.hashes(starts, ends)
    edge = np.zeros(len(h) + 1, np.int64)
    items: list[set[int]] = [set() for _ in range(piece.n)]
    for n, (keys, begin, item) in index.by_length.items():
        if len(h) < n:
            continue
        whole = grams(h, n)
        if n == WINDOW:
            g, keep = _selected(h, docs)
            kept = np.unique(keep[keep >= 0])
            hit = kept[isin_sorted(g[kept], index.fingerprints)]
            at = np.unique((hit[:, None] - np.arange(WINDOW - GRAM + 1)[None, :]).ravel())
            at = at[(at >= 0) & (at < len(whole))]
            at = at[keep[at] >= 0]
        else:
            at = np.flatnonzero(inside(docs, n))
        at = at[isin_sorted(whole[at], keys)]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + n, -1)
        which = np.searchsorted(keys, whole[at])
        for doc, k in np.unique(np.stack([docs[at], which], 1), axis=0) if len(at) else ():
            items[doc].update(item[begin[k] : begin[k + 1]].tolist())
    return docs, np.cumsum(edge[:-1]) > 0, items


def _pass(documents: DataFrame, index, id_type: str) -> DataFrame:
    """Scan all documents with an index that fits a task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Index = index.value
        for batch in batches:
            ids = batch.column("doc_id")
            for piece in slices(batch.column("text")):
                docs, hit, items = _hits(piece, block)
                n_words, n_hit = (pa.array(np.bincount(x, minlength=piece.n).astype(np.int64)) for x in (docs, docs[hit]))
                named = pa.array([[block.items[i] for i in sorted(x) if i >= 0] for x in items], pa.list_(pa.string()))
                yield pa.record_batch([ids.slice(piece.first, piece.n), n_words, n_hit, named], names=["doc_id", "n_words", "n_hit", "items"])

    return documents.select("doc_id", "text").mapInArrow(rows, f"doc_id {id_type}, n_words long, n_hit long, items array<string>")


def _document_windows(numbered: DataFrame, lengths: list[int]) -> DataFrame:
    """``doc, length, fingerprint, at, windows``: fingerprints with the hashes of the windows, from word ``at`` on, that chose them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column("text")):
                low = piece.lowered()
                starts, ends, docs = low.words("alnum")
                h = low.hashes(starts, ends)
                begins = np.searchsorted(docs, np.arange(piece.n))
                for n in lengths:
                    if len(h) < n:
                        continue
                    whole = grams(h, n)
                    if n == WINDOW:
                        g, keep = _selected(h, docs)
                        first = np.flatnonzero(np.append(True, keep[1:] != keep[:-1]))
                        size = np.diff(np.append(first, len(keep)))
                        first, size = first[keep[first] >= 0], size[keep[first] >= 0]
                        prints = g[keep[first]]
                    else:
                        first = np.flatnonzero(inside(docs, n))
                        size, prints = np.ones(len(first), np.int64), whole[first]
                    cut = np.append(0, np.cumsum(size))
                    windows = whole[np.repeat(first - cut[:-1], size) + np.arange(cut[-1])]
                    lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(windows.view(np.int64)))
                    of = docs[first]
                    columns = [batch.column("doc").take(pa.array(of + piece.first)), pa.array(np.full(len(first), n, np.int32)), pa.array(prints.view(np.int64)), pa.array(first - begins[of]), lists]
                    yield pa.record_batch(columns, names=["doc", "length", "fingerprint", "at", "windows"])

    source = numbered.select(F.col("__doc").alias("doc"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(rows, "doc long, length int, fingerprint long, at long, windows array<long>")


def _joined(numbered: DataFrame, windows: DataFrame) -> DataFrame:
    """``doc, start, length, item``: where documents hold benchmark windows."""
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())  # at most WINDOW numbers
    own = _document_windows(numbered, lengths).join(windows.select("length", "fingerprint").distinct(), ["length", "fingerprint"], "left_semi")
    each = own.select("doc", "length", "at", F.posexplode("windows").alias("nth", "window_hash"))
    known = windows.select("length", "window_hash", "item").distinct()
    return each.join(known, ["length", "window_hash"]).select("doc", (F.col("at") + F.col("nth")).alias("start"), "length", "item")


def _covered(ranges: Column) -> Column:
    """How many words sorted ranges ``(start, length)`` cover; they may overlap."""
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(a, r):
        end = r["start"] + r["length"]
        return F.struct((a["n"] + F.greatest(F.lit(0), end - F.greatest(r["start"], a["end"]))).alias("n"), F.greatest(a["end"], end).alias("end"))

    return F.aggregate(ranges, nothing, add)["n"]


def contamination(documents: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, items`` (sorted distinct item ids with a hit)."""
    spark = documents.sparkSession
    documents = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = documents.schema["doc_id"].dataType.simpleString()
    windows = benchmark_windows(benchmark)
    if windows.count() <= block_windows:
        return _pass(documents, spark.sparkContext.broadcast(Index(windows.collect())), id_type)
    numbered = with_row_numbers(documents)
    windows = written(windows, "benchmark-windows")
    found = _joined(numbered, windows).groupBy(F.col("doc").alias("__of")).agg(
        _covered(F.array_sort(F.collect_set(F.struct("start", "length")))).alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items")
    )

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b.column("text")):
                n = np.bincount(piece.lowered().words("alnum")[2], minlength=piece.n).astype(np.int64)
                part = b.slice(piece.first, piece.n)
                yield pa.record_batch([part.column("__doc"), part.column("doc_id"), pa.array(n)], names=["__doc", "doc_id", "n_words"])

    sizes = numbered.select("__doc", "doc_id", "text").mapInArrow(counts, f"__doc long, doc_id {id_type}, n_words long")
    return sizes.join(found, F.col("__doc") == F.col("__of"), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents without those that hold a benchmark window, with all their columns."""
    windows = benchmark_windows(benchmark)
    if windows.count() > block_windows:
        numbered = with_row_numbers(documents)
        hit = _joined(numbered, written(windows, "benchmark-windows")).select(F.col("doc").alias("__of")).distinct()
        return numbered.join(hit, F.col("__doc") == F.col("__of"), "left_anti").select(*documents.columns)
    index = documents.sparkSession.sparkContext.broadcast(Index(windows.collect()))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b.column("text")):
                docs, hit, _ = _hits(piece, index.value)
                yield b.slice(piece.first, piece.n).filter(pa.array(np.bincount(docs[hit], minlength=piece.n) == 0))

    return documents.mapInArrow(clean, documents.schema)


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contract columns over all documents and items."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP3_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents
), iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[i : i + least(10, len(words)) - 1], ' ') AS gram
  FROM iw, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS t(i)
  WHERE len(words) > 0
), lens AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, i, n, array_to_string(words[i : i + n - 1], ' ') AS gram
  FROM dw, lens, unnest(range(1, len(words) - n + 2)) AS t(i)
), hit AS (
  SELECT g.doc_id, g.i, g.n, w.item_id FROM grams g JOIN win w ON g.n = w.n AND g.gram = w.gram
), words_hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit), unnest(range(i, i + n)) AS t(j) GROUP BY doc_id
), items_hit AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words_hit h ON d.doc_id = h.doc_id LEFT JOIN items_hit i ON d.doc_id = i.doc_id
"""
