"""Exact substring deduplication with longest-previous-factor arrays.

The longest previous factor (LPF) of a position is the longest string from there that also starts earlier;
it is the larger of the common prefixes with the previous and the next smaller position in suffix order.
A window of ``LENGTH`` bytes occurs earlier where the LPF is at least ``LENGTH``, and the earlier occurrence
is then a source. ``dedup_substrings`` removes later copies and keeps the first; ``repeated_bytes`` also
tells the sources, which gives all occurrences.

No task could hold the suffixes of a corpus, so they are divided first. Each window of ``LENGTH`` bytes
chooses the minimum hash of its ``ANCHOR``-byte strings (winnowing); equal windows choose equal anchors, so
windows are compared only with those of the same anchor. An anchor stands for a span of neighbouring
windows. Equal spans of an anchor are one: the first stands for all, and the others repeat as a whole. Where
an anchor has different spans, their texts are read again, and the suffixes that start in them get their
order by bytes (prefix doubling to a depth of ``LENGTH``), from which previous and next smaller positions
give the LPF array, cut at ``LENGTH``. Equality there is equality of bytes, not of hashes; equal spans are told by two
64-bit hashes, the anchor's and the span's.

Hot anchors aren't gathered in one task. Anchors that may hold more than one in ``HEAVY`` of all spans are found
by a frequent-items sketch; their equal spans meet by partial aggregation and a join that Spark splits.
Where an anchor has more than ``HOT`` different spans, its windows are dealt out by a fingerprint instead of
the anchor, and the first of equal ones is found by partial aggregation: the smallest position among equal
suffixes is what the LPF array points to in the end.

Texts longer than ``PIECE`` bytes are read in pieces that overlap by a window, so memory doesn't follow the
length of a text, apart from the text itself.

Edge cases: null and empty texts, and texts shorter than ``LENGTH``, have no windows; rows equal in id and
text are copies of each other, of which ``dedup_substrings`` keeps one; null ids are kept; the order of documents is that of integer ids where they
are unique and not null, else the order in which the rows are read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.llm.common import with_row_numbers, written
from ruleloom.llm.textops import Slice, mix, slices

LENGTH, ANCHOR = 200, 100
HEAVY, HOT, BLOCK, PIECE = 5_000, 5_000, 1_500, 2 << 20
DEPTHS = (8, 16, 32, 64, 128)  # of prefix doubling; two of the last cover a window
_LOW = np.uint64(0xFFFFFFFF)


def smaller_neighbours(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each rank of a suffix order, the nearest rank before and after it that holds a smaller position (-1: none)."""

    def before(x: np.ndarray) -> np.ndarray:
        at = np.arange(len(x)) - 1
        while True:
            bad = np.flatnonzero((at >= 0) & (x[at] > x))
            if not len(bad):
                return at
            at[bad] = at[at[bad]]

    n = len(order)
    after = n - 1 - before(order[::-1])[::-1]
    return before(order), np.where(after == n, -1, after)


def longest_previous(order: np.ndarray, common) -> tuple[np.ndarray, np.ndarray]:
    """LPF and source of each position. ``order`` is a suffix order, ``common(r, s)`` the common prefixes of ranks."""
    lpf, source = np.zeros(len(order), np.int64), np.full(len(order), -1)
    if not len(order):
        return lpf, source
    for near in smaller_neighbours(order):
        ranks = np.flatnonzero(near >= 0)
        n = common(ranks, near[ranks])
        at = order[ranks]
        better = n > lpf[at]
        lpf[at[better]], source[at[better]] = n[better], order[near[ranks[better]]]
    return lpf, source


class SuffixOrder:
    """The order of the suffixes of ``data`` that start at ``starts``, to a depth of ``LENGTH`` bytes, then by index.

    Each start has ``LENGTH`` bytes from there on.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        n = len(data)
        padded = np.zeros(n + 2 * LENGTH, np.uint64)
        padded[:n] = data
        self.starts, self.eight = starts, np.zeros(n + LENGTH, np.uint64)
        for k in range(8):
            self.eight |= padded[k : k + n + LENGTH] << np.uint64(56 - 8 * k)
        key, self.ranks = self.eight, []
        for depth in DEPTHS:
            if self.ranks:
                half = self.ranks[-1].astype(np.int64)
                key = half * len(half) + np.append(half[depth // 2 :], np.zeros(depth // 2, np.int64))
            order = np.argsort(key)
            new = np.append(False, key[order[1:]] != key[order[:-1]])
            rank = np.empty(len(key), np.int32)
            rank[order] = np.cumsum(new)
            self.ranks.append(rank)
        whole = self.ranks[-1].astype(np.int64)
        self.order = np.argsort(whole[starts] * len(whole) + whole[starts + LENGTH - DEPTHS[-1]], kind="stable")

    def common(self, r: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Common prefixes of the suffixes at these ranks, at most ``LENGTH``."""
        i, j = self.starts[self.order[r]], self.starts[self.order[s]]
        n = np.zeros(len(i), np.int64)
        for depth, rank in zip(reversed(DEPTHS), reversed(self.ranks), strict=True):
            n += np.where(rank[i + n] == rank[j + n], depth, 0)
        n = np.minimum(n, LENGTH)
        differ = self.eight[i + n] ^ self.eight[j + n]
        for k in range(7, 0, -1):
            n += differ < np.uint64(1 << (8 * k))
        return np.minimum(n, LENGTH)


def window_anchors(piece: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a slice: document, first and last window that chose the anchor, and its position."""
    data, offsets = piece.data, piece.offsets
    lengths = np.diff(offsets)
    none = np.zeros(0, np.int64)
    if not (lengths >= LENGTH).any():
        return none, none, none, none
    n = len(data) - ANCHOR + 1
    at = np.arange(n)
    x = piece.hashes(at, at + ANCHOR) & ~_LOW
    x |= _LOW - at.astype(np.uint64)  # of equal hashes the last one
    width = LENGTH - ANCHOR + 1
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    to = np.minimum.accumulate(blocks, axis=1).ravel()
    from_ = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    total = np.maximum(lengths - LENGTH + 1, 0)
    docs = np.repeat(np.arange(piece.n), total)
    starts = np.repeat(offsets[:-1] - (np.cumsum(total) - total), total) + np.arange(total.sum())
    chosen = (_LOW - (np.minimum(from_[starts], to[starts + width - 1]) & _LOW)).astype(np.int64)
    first = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (docs[1:] != docs[:-1])))
    last = np.append(first[1:], len(starts)) - 1
    return docs[first], starts[first], starts[last], chosen[first]


def _numbered(documents: DataFrame) -> DataFrame:
    """``doc, doc_id, text`` with a number for each row."""
    own = with_row_numbers(documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    return own.select(F.col("__doc").alias("doc"), "doc_id", "text")


def _pieces_of(piece: Slice) -> Iterator[tuple[Slice, int]]:
    """A slice, or a long text's pieces and where they begin; windows that cross a cut are in one piece each."""
    if piece.n > 1 or len(piece.data) <= PIECE + LENGTH:
        yield piece, 0
        return
    for at in range(0, len(piece.data) - LENGTH + 1, PIECE):
        data = piece.data[at : at + PIECE + LENGTH - 1]
        yield Slice(piece.first, data, np.array([0, len(data)])), at


def _anchor_rows(numbered: DataFrame) -> DataFrame:
    """``doc, lo, windows, anchor, span``; ``lo`` is the first window's byte, ``windows`` their number and the anchor's offset."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for whole in slices(b.column("text")):
                for piece, skipped in _pieces_of(whole):
                    docs, lo, hi, at = window_anchors(piece)
                    anchor = piece.hashes(at, at + ANCHOR)
                    span = mix(piece.hashes(lo, hi + LENGTH) + (at - lo).astype(np.uint64))
                    place = ((lo - piece.offsets[docs] + skipped) << 16) | ((hi - lo) << 8) | (at - lo)
                    yield pa.record_batch(
                        [b.column("doc").take(pa.array(docs + piece.first)), pa.array(place), pa.array(anchor.view(np.int64)), pa.array(span.view(np.int64))],
                        names=["doc", "place", "anchor", "span"],
                    )

    # place: first byte, number of further windows, offset of the anchor, in one long
    return numbered.select("doc", "text").mapInArrow(rows, "doc long, place long, anchor long, span long")


_LO, _MORE = "shiftright(place, 16)", "shiftright(place, 8) & 255"


def _span_texts(numbered: DataFrame, spans: DataFrame) -> DataFrame:
    """``anchor, doc, place, bytes``: the text of each span of ``spans (doc, place, anchor)``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("spans")
            cut, values = np.asarray(lists.offsets), lists.values
            place = values.field("place").to_numpy()
            for piece in slices(b.column("text")):
                i = np.arange(cut[piece.first], cut[piece.first + piece.n])
                docs = np.repeat(np.arange(piece.n), np.diff(cut[piece.first : piece.first + piece.n + 1]))
                for part in range(0, len(i), 8192):
                    k, of = i[part : part + 8192], docs[part : part + 8192]
                    lo, n = (place[k] >> 16) + piece.offsets[of], ((place[k] >> 8) & 255) + LENGTH
                    begin = np.cumsum(n) - n
                    data = piece.data[np.repeat(lo - begin, n) + np.arange(n.sum())]
                    offsets = np.append(begin, n.sum()).astype(np.int32)
                    texts = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
                    take = pa.array(k)
                    yield pa.record_batch([values.field("anchor").take(take), b.column("doc").take(pa.array(of + piece.first)), pa.array(place[k]), texts], names=["anchor", "doc", "place", "bytes"])

    lists = spans.groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("place", "anchor")).alias("spans"))
    joined = numbered.join(lists, F.col("doc") == F.col("__doc")).select("doc", "text", "spans")
    return joined.mapInArrow(rows, "anchor long, doc long, place long, bytes binary")


def _pieces(mask: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs of true values that stay within one span."""
    at = np.flatnonzero(mask)
    if not len(at):
        return at, at
    new = np.append(True, (at[1:] != at[:-1] + 1) | (of[at[1:]] != of[at[:-1]]))
    first = np.flatnonzero(new)
    return at[first], at[np.append(first[1:], len(at)) - 1]


def _windows(doc: np.ndarray, place: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of spans, and for each window its span, its byte in the document and its place in the bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    n = ((place >> 8) & 255) + 1
    of = np.repeat(np.arange(len(n)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return data, of, (place >> 16)[of] + nth, (offsets[:-1] - offsets[0])[of] + nth


def compare_block(doc: np.ndarray, place: np.ndarray, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """``doc, start, end, earlier`` of the windows of these spans that occur twice among them."""
    data, of, byte, at = _windows(doc, place, texts)
    by_position = np.lexsort((byte, doc[of]))
    suffixes = SuffixOrder(data, at[by_position])
    lpf, source = longest_previous(suffixes.order, suffixes.common)
    earlier, again = np.zeros(len(of), bool), np.zeros(len(of), bool)
    earlier[by_position] = lpf >= LENGTH
    again[by_position[source[lpf >= LENGTH]]] = True
    for mask, flag in ((earlier, True), (again & ~earlier, False)):
        a, z = _pieces(mask, of)
        yield pa.record_batch([pa.array(doc[of[a]]), pa.array(byte[a]), pa.array(byte[z] + LENGTH), pa.array(np.full(len(a), flag))], names=["doc", "start", "end", "earlier"])


def _compare(spans: DataFrame) -> DataFrame:
    """``doc, start, end, earlier``: windows that occur again in another span of their anchor."""

    def block(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole anchors, about ``BLOCK`` spans or one anchor at a time."""
        t = t.combine_chunks()
        anchor = t.column("anchor").to_numpy()
        ends = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor))
        at = 0
        while at < len(anchor):
            end = ends[max(np.searchsorted(ends, at + BLOCK, "right") - 1, np.searchsorted(ends, at, "right"))]
            part = t.slice(at, end - at)
            yield from compare_block(part.column("doc").to_numpy(), part.column("place").to_numpy(), part.column("bytes"))
            at = end

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= HOT:  # whole anchors only: the last one waits for the rest of its rows
                t = pa.Table.from_batches(held)
                anchor = t.column("anchor").to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1]))
                if cut:
                    yield from block(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                size = t.num_rows - cut
        if held:
            yield from block(pa.Table.from_batches(held))

    dealt = spans.repartition(F.col("anchor")).sortWithinPartitions("anchor")
    return dealt.mapInArrow(rows, "doc long, start long, end long, earlier boolean")


def _compare_hot(spans: DataFrame) -> DataFrame:
    """The same for anchors of very many different spans: their windows meet by fingerprint."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, place = b.column("doc").to_numpy(), b.column("place").to_numpy()
            for first in range(0, b.num_rows, 1024):
                part = slice(first, first + 1024)
                data, of, byte, at = _windows(doc[part], place[part], b.column("bytes").slice(first, 1024))
                prints = Slice(0, data, np.array([0, len(data)])).hashes(at, at + LENGTH).view(np.int64)
                anchor = b.column("anchor").slice(first, 1024).take(pa.array(of))
                yield pa.record_batch([anchor, pa.array(prints), pa.array(doc[part][of]), pa.array(byte)], names=["anchor", "print", "doc", "byte"])

    one = spans.mapInArrow(rows, "anchor long, print long, doc long, byte long")
    at = F.struct("doc", "byte")
    several = one.groupBy("anchor", "print").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").drop("last")
    return one.join(several, ["anchor", "print"]).select("doc", F.col("byte").alias("start"), (F.col("byte") + LENGTH).alias("end"), (at > F.col("first")).alias("earlier"))


def _heavy_anchors(rows: DataFrame) -> list[int]:
    """Anchors of one in ``HEAVY`` of all spans or more, of which there are at most ``HEAVY``, and perhaps others."""
    most = rows.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(anchor, {HEAVY}, {4 * HEAVY})").alias("top")).first()
    return [x.item for x in most.top or () if x["count"] * HEAVY >= most.n]


def _with_copies(rows: DataFrame) -> DataFrame:
    """``doc, place, anchor, again, whole, mixed`` of the spans whose anchor occurs again.

    ``again``: an earlier span of the anchor is equal as a whole; ``whole``: an earlier or later one is;
    ``mixed``: the anchor has different spans.
    """
    heavy = _heavy_anchors(rows)
    is_heavy = F.col("anchor").isin(heavy) if heavy else F.lit(False)
    by_anchor = Window.partitionBy("anchor")
    in_order = by_anchor.orderBy("span", "doc", "place")
    light = rows.where(~is_heavy).withColumn("prev", F.lag("span").over(in_order)).withColumn("next", F.lead("span").over(in_order))
    light = light.withColumn("n", F.count("*").over(by_anchor)).where("n > 1")
    light = light.withColumn("mixed", F.min("span").over(by_anchor) != F.max("span").over(by_anchor))
    again, more = F.coalesce(F.col("span") == F.col("prev"), F.lit(False)), F.coalesce(F.col("span") == F.col("next"), F.lit(False))
    light = light.select("doc", "place", "anchor", again.alias("again"), (again | more).alias("whole"), "mixed")
    if heavy:
        own = written(rows.where(is_heavy), "lpf-heavy")
        at = F.struct("doc", "place")
        firsts = written(own.groupBy("anchor", "span").agg(F.min(at).alias("first"), F.count("*").alias("n")), "lpf-firsts")
        joined = own.join(firsts, ["anchor", "span"])
        light = light.union(joined.select("doc", "place", "anchor", (at != F.col("first")).alias("again"), (F.col("n") > 1).alias("whole"), F.lit(True).alias("mixed")))
    return light.where("whole or mixed")


def repeated_bytes(numbered: DataFrame) -> DataFrame:
    """``doc, start, end, earlier``: byte ranges made of repeated windows; ``earlier`` where they occur before."""
    rows = written(_with_copies(_anchor_rows(numbered)), "lpf-anchors")
    whole = rows.where("whole").select("doc", F.expr(_LO).alias("start"), (F.expr(_LO) + F.expr(_MORE) + LENGTH).alias("end"), F.col("again").alias("earlier"))
    spans = written(_span_texts(numbered, rows.where("mixed and not again").select("doc", "place", "anchor")), "lpf-spans")
    hot = written(spans.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor"), "lpf-hot")
    if not hot.take(1):
        return whole.union(_compare(spans))
    return whole.union(_compare(spans.join(hot, "anchor", "left_anti"))).union(_compare_hot(spans.join(hot, "anchor", "left_semi")))


def _without(documents: DataFrame, numbered: DataFrame, ranges: DataFrame, keep_text: bool) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, and the text that stays."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, spans, digest, texts = [], [], [], [], []
            for raw, found in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("ranges").to_pylist(), strict=True):
                raw, pieces, at, removed, n = raw or b"", [], 0, 0, 0
                end = -1
                for r in sorted((r["start"], r["end"]) for r in found or ()):
                    if r[0] > end:
                        n += 1
                        pieces.append(raw[at : r[0]])
                        removed += r[1] - r[0]
                        at = end = r[1]
                    elif r[1] > end:
                        removed += r[1] - end
                        at = end = r[1]
                pieces.append(raw[at:])
                kept = b"".join(pieces)
                size.append(len(raw)), gone.append(removed), spans.append(n), digest.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode("utf-8", "ignore") if keep_text else None)
            long = lambda x: pa.array(x, pa.int64())
            out = [b.column("doc_id"), b.column("doc"), long(size), long(gone), long(spans), pa.array(digest, pa.string()), pa.array(texts, pa.string())]
            yield pa.record_batch(out, names=["doc_id", "doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    merged = written(ranges.groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("ranges")), "lpf-ranges").withColumnRenamed("doc", "__doc")
    joined = numbered.join(merged, F.col("doc") == F.col("__doc"), "left").select("doc_id", "doc", "text", "ranges")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(rows, f"doc_id {kind}, doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")


def dedup_substrings(documents: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``: later copies go, the first stays.

    A multi-byte character that loses a part of its bytes is left out of ``kept``.
    """
    numbered = _numbered(documents)
    return _without(documents, numbered, repeated_bytes(numbered).where("earlier"), True).drop("doc")


def op7_columns(documents: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``: every occurrence of a repeated string goes."""
    numbered = _numbered(documents)
    return _without(documents, numbered, repeated_bytes(numbered), False).drop("doc", "kept")


def op7_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract columns over all documents."""
    return op7_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
