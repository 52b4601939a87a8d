"""Substring deduplication by paragraphs: MinHash bands, exact verification, components.

A text is cut into paragraphs at line ends, and within a line after each sentence of ``SENTENCE_WORDS``
words or more. A cut depends on the sentence before it alone, so a passage that is set into other text
keeps its inner cuts and its inner paragraphs are found again. Neighbouring paragraphs of fewer than
``MIN_WORDS`` words are joined to units of ``MIN_WORDS`` words or more. One that has no such neighbours makes
further units with the paragraph before it and the one after it, which are equal to others or not, as runs
are (see below); if its text holds no other, it is a unit itself. Each unit has the set of its runs of
``SHINGLE`` words. Paragraphs of equal sets are one node; nodes that share one of ``BANDS`` bands of ``ROWS`` MinHash values are candidates, verified by exact Jaccard
similarity and joined into classes (module ``links``).

Sentences depend on punctuation, so runs of ``CHUNK`` words are units too: those that start at the smallest
hash of ``SHINGLE`` words among ``CHUNK`` neighbouring places of a document. Where they start depends on
words alone, so any ``2 * CHUNK - 1`` consecutive words that stand in two places have a run in common there,
whatever the punctuation and the text around them. Runs are equal or not: one changed word within a run
brings its similarity below the threshold, so they need no bands. Runs overlap each other and the sentences;
a unit that overlaps the one of its class that stays, stays too.

Of each class the first paragraph (smallest document id, null last) stays and all others go. With
``run_words``, an option that is off, they go only where neighbouring ones that go have so many words in all.

``bands_for`` tells how many bands a recall needs; the defaults find a pair at the threshold in 99.8 % of
cases and the more similar ones practically always.

Documents are read twice. The first pass emits the bands of paragraphs and the hashes of runs into one
shuffle, whose sorted rows tell which nodes meet others and which occur again. The second pass lists the
units of these, with the sets of those that need to be compared. A table of ``BITS`` bits tells it which:
it may let others pass, never drops one, and classes are counted exactly afterwards.

Edge cases: null and empty texts have no paragraphs; rows equal in id and text are copies of each other
of which one stays; null ids are kept, and come last; an empty table gives an empty result;
``dedup_paragraphs`` keeps all other columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.llm.common import discard, with_row_numbers, written
from ruleloom.llm.links import link
from ruleloom.llm.textops import Slice, _powers as powers, grams, mix, seeded, slices

SHINGLE, THRESHOLD = 5, 0.8
SENTENCE_WORDS, MIN_WORDS, CHUNK = 6, 6, 25
BANDS, ROWS = 6, 2
BITS = 1 << 27
_SPACE, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = _STOP[list(b".!?")] = True
_RUN = 7  # where the bands of paragraphs have their numbers, below it
_STEP = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, recall: float, rows: int = ROWS) -> int:
    """The fewest bands that find a pair at the threshold with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _joined(first: np.ndarray, last: np.ndarray, words: np.ndarray, docs: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """First and last words of the units that paragraphs give, and of further ones that overlap these: no paragraph is left out for being short."""
    short = np.flatnonzero(words < MIN_WORDS)
    begin = np.flatnonzero(np.append(True, (np.diff(short) > 1) | (docs[short[1:]] != docs[short[:-1]]))) if len(short) else short
    own: list[tuple[int, int]] = []
    more: list[tuple[int, int]] = []
    for a, b in zip(short[begin].tolist(), short[np.append(begin[1:], len(short)) - 1].tolist() if len(short) else [], strict=True):
        n, at, before = 0, a, len(own)
        for i in range(a, b + 1):
            n += int(words[i])
            if n >= MIN_WORDS:
                own.append((at, i))
                n, at = 0, i + 1
        if not n:
            continue
        if len(own) > before:
            own[-1] = (own[-1][0], b)
            continue
        left, right = a > 0 and docs[a - 1] == docs[a], b + 1 < len(docs) and docs[b + 1] == docs[b]
        if left:
            more.append((a - 1, b))
        if right:
            more.append((a, b + 1))
        if not left and not right:
            own.append((a, b))
    own_at, more_at = (np.array(x, np.int64).reshape(-1, 2) for x in (own, more))
    long = words >= MIN_WORDS
    first_own, last_own = np.append(first[long], first[own_at[:, 0]]), np.append(last[long], last[own_at[:, 1]])
    order = np.argsort(first_own, kind="stable")
    return (first_own[order], last_own[order]), (first[more_at[:, 0]], last[more_at[:, 1]])


class Paragraphs:
    """The units of a slice: document, order in it, bytes, words and shingles."""

    def __init__(self, piece: Slice):
        low = piece.lowered()
        starts, ends, docs = low.words("alnum")
        self.text, self.word_starts, self.word_ends, self.word_docs = low, starts, ends, docs
        n = len(starts)
        data = low.data
        newline = np.append(0, np.cumsum(data == 10, dtype=np.int64))
        stops = np.append(0, np.cumsum(_STOP[data], dtype=np.int64))
        last_space = np.append(0, np.maximum.accumulate(np.where(_SPACE[data], np.arange(len(data)), 0)))  # before a place
        other = np.append(docs[1:] != docs[:-1], True) if n else np.zeros(0, bool)
        to = np.append(starts[1:], len(data)) if n else starts
        hard = other | (newline[to] > newline[ends])  # after this word a text or a line ends
        soft = hard | (stops[np.maximum(last_space[to], ends)] > stops[ends])  # a stop, and white space before the next word
        last = np.flatnonzero(soft)
        length = np.diff(np.append(-1, last))
        cut = last[hard[last] | (length >= SENTENCE_WORDS)]
        first = np.append(0, cut[:-1] + 1) if len(cut) else cut
        words = cut - first + 1
        (first, cut), self.more = _joined(first, cut, words, docs[first])
        self.words, self.docs, self.first = cut - first + 1, docs[first], first
        self.hashes = low.hashes(starts, ends)
        self.grams = g = grams(self.hashes, SHINGLE)
        size = np.maximum(self.words - SHINGLE + 1, 1)
        self.begin = np.cumsum(size) - size
        padded = np.append(g, np.zeros(SHINGLE - 1, np.uint64))
        self.shingles = padded[np.repeat(first - self.begin, size) + np.arange(size.sum())] if len(first) else g[:0]
        for u in np.flatnonzero(self.words < SHINGLE):  # a whole text of fewer words: all of them are its only item
            self.shingles[self.begin[u]] = grams(self.hashes[first[u] : cut[u] + 1], int(self.words[u]))[0] ^ np.uint64(self.words[u])
        self.of = np.repeat(np.arange(len(first)), size)

    @cached_property
    def sets(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles and the paragraph of each, paragraphs in order."""
        key = (self.of.astype(np.uint64) << np.uint64(40)) | (self.shingles >> np.uint64(24))
        order = np.argsort(key)
        key, h = key[order], self.shingles[order]
        if len(self.words) >= 1 << 24 or ((key[1:] == key[:-1]) & (h[1:] != h[:-1])).any():
            order = np.lexsort((self.shingles, self.of))
            h = self.shingles[order]
        of = self.of[order]
        new = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])) if len(h) else np.zeros(0, bool)
        return h[new], of[new]

    @cached_property
    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each paragraph's set, and the size of the set."""
        h, of = self.sets
        size = np.bincount(of, minlength=len(self.words))
        begin = np.cumsum(size) - size
        total = np.add.reduceat(mix(h), begin) if len(h) else np.zeros(0, np.uint64)
        return mix(total + size.astype(np.uint64)).view(np.int64), size

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word and number of words of each unit that is equal to others or not, and a hash of its words."""
        at = self.chunks()
        first = np.append(at, self.more[0])
        last = np.append(at + CHUNK - 1, self.more[1])
        power, inverse = powers(len(self.hashes) + 1)
        total = np.append(np.uint64(0), np.cumsum(self.hashes * power[: len(self.hashes)]))
        words = last - first + 1
        return first, words, mix((total[last + 1] - total[first]) * inverse[first] + words.astype(np.uint64)).view(np.int64)

    def chunks(self) -> np.ndarray:
        """The first word of each run of ``CHUNK`` words that counts."""
        g, docs = self.grams, self.word_docs
        n = len(docs) - CHUNK - SHINGLE + 2  # windows of CHUNK places
        if n <= 0:
            return np.zeros(0, np.int64)
        value, at, width = g, np.arange(len(g)), 1
        while width < CHUNK:  # the rightmost smallest of ``width`` places, from each place on
            step = min(width, CHUNK - width)
            less = value[step:] <= value[:-step]
            value, at = np.where(less, value[step:], value[:-step]), np.where(less, at[step:], at[:-step])
            width += step
        chosen = np.zeros(len(docs), bool)
        chosen[at[docs[:n] == docs[CHUNK + SHINGLE - 2 :]]] = True
        first = np.flatnonzero(chosen[: len(docs) - CHUNK + 1])
        return first[docs[first] == docs[first + CHUNK - 1]]

    def units(self, again: np.ndarray, met: np.ndarray) -> tuple:
        """Document, start, end, first word, words, node and items of the units whose node is in ``again``, in order.

        Items, the set, are there for the first unit of each node that is in ``met``, else null.
        """
        at, length, hashed = self.runs()
        node, size = self.nodes
        _, new = np.unique(node, return_index=True)
        compared = np.zeros(len(node), bool)
        compared[new] = _in_bits(met, node[new])
        own, run = np.flatnonzero(_in_bits(again, node)), np.flatnonzero(_in_bits(again, hashed))
        first = np.append(self.first[own], at[run])
        words = np.append(self.words[own], length[run])
        nodes = np.append(node[own], hashed[run])
        order = np.lexsort((words, first))
        sentence = np.append(own, np.full(len(run), -1))[order]
        first, words, nodes = first[order], words[order], nodes[order]
        with_items = (sentence >= 0) & compared[sentence] if len(node) else np.zeros(len(sentence), bool)
        n = np.where(with_items, size[sentence], 0) if len(node) else np.zeros(len(sentence), np.int64)
        begin = (np.cumsum(size) - size)[sentence] if len(node) else n
        cut = np.append(0, np.cumsum(n))
        h, _ = self.sets
        items = h[np.repeat(begin - cut[:-1], n) + np.arange(cut[-1])] if len(h) else h
        lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(items.view(np.int64)), mask=pa.array(~with_items))
        docs = self.word_docs[first]
        begins = np.searchsorted(self.word_docs, docs)  # the document's first word
        offset = self.text.offsets[docs]
        return docs, self.word_starts[first] - offset, self.word_ends[first + words - 1] - offset, first - begins, words, nodes, lists

    def bands(self) -> np.ndarray:
        """One bucket per band for each paragraph; the lowest bits tell the band."""
        out = np.zeros((len(self.words), BANDS), np.uint64)
        if len(out):
            for b in range(BANDS):
                x = np.full(len(out), b + 1, np.uint64)
                for r in range(ROWS):
                    x = mix(x * _STEP + np.minimum.reduceat(seeded(self.shingles, b * ROWS + r), self.begin))
                out[:, b] = (x & ~np.uint64(_RUN)) | np.uint64(b)
        return out.view(np.int64)


def _map(documents: DataFrame, schema: str, columns) -> DataFrame:
    """Run ``columns(batch, piece, paragraphs)`` over all texts; it returns arrays in the schema's order."""
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b.column("text")):
                yield pa.record_batch([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns(b, piece, Paragraphs(piece))], names=names)

    return documents.mapInArrow(rows, schema)


def _narrow(numbered: DataFrame) -> DataFrame:
    return numbered.select(F.col("__doc").alias("doc"), "doc_id", F.col("text").cast("string").alias("text"))


def _in_bits(bits: np.ndarray, node: np.ndarray) -> np.ndarray:
    return (bits[node & (BITS // 64 - 1)] >> ((node.view(np.uint64) >> np.uint64(32)) & np.uint64(63))) & np.uint64(1) > 0


def _bits(nodes: DataFrame) -> np.ndarray:
    """A table of ``BITS`` bits with those of all nodes, and by chance of some others."""
    at = F.col("node").bitwiseAND(F.lit(BITS // 64 - 1).cast("long")).alias("at")
    table = nodes.groupBy(at).agg(F.expr("bit_or(shiftleft(1L, cast(shiftrightunsigned(node, 32) & 63 as int)))").alias("bits")).toArrow()
    bits = np.zeros(BITS // 64, np.int64)
    bits[table.column("at").to_numpy()] = table.column("bits").to_numpy()
    return bits.view(np.uint64)


def _entries(numbered: DataFrame) -> DataFrame:
    """``bucket, node, size``: a bucket for each band of each paragraph, and one for each run.

    A node that occurs several times within a slice comes once, its size with a minus sign.
    """

    def columns(b, piece, p):
        node, size = p.nodes
        _, first, n = np.unique(node, return_index=True, return_counts=True)
        run, of_run = np.unique(p.runs()[2], return_counts=True)
        bucket = np.append(p.bands()[first].ravel(), run | np.int64(_RUN))
        signed = np.where(n > 1, -size[first], size[first])
        return [bucket, np.append(np.repeat(node[first], BANDS), run), np.append(np.repeat(signed, BANDS), np.where(of_run > 1, -1, 1)).astype(np.int32)]

    return _map(_narrow(numbered).select("text"), "bucket long, node long, size int", columns)


def _shared(entries: DataFrame) -> DataFrame:
    """The distinct entries of buckets that hold several nodes, and, with sizes below 0, the nodes that occur again.

    One shuffle, then a pass over the sorted rows.
    """
    names = ["bucket", "node", "size"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, follows = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)], False
        for b in batches:
            bucket, node, size = (np.append(h, c.to_numpy()) for h, c in zip(held, b.columns, strict=True))
            if not len(bucket):
                continue
            first = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1])))
            again = (np.diff(np.append(first, len(bucket))) > 1) | (np.minimum.reduceat(size, first) < 0)
            bucket, node, size = bucket[first], node[first], np.abs(size[first])
            like_next = bucket[1:] == bucket[:-1]
            like_before = np.append(follows, like_next)
            band = bucket & _RUN
            meet = (like_before[:-1] | like_next) & (band[:-1] != _RUN)  # the last row waits for the one after it
            more = again[:-1] & ((band[:-1] == 0) | (band[:-1] == _RUN))
            yield pa.record_batch([pa.array(x[:-1][meet]) for x in (bucket, node, size)], names=names)
            yield pa.record_batch([pa.array(x[:-1][more]) for x in (bucket, node, -size)], names=names)
            held, follows = [bucket[-1:], node[-1:], np.where(again[-1:], -size[-1:], size[-1:])], bool(like_before[-1])
        if len(held[0]):
            band = int(held[0][0]) & _RUN
            size = np.abs(held[2])
            if follows and band != _RUN:
                yield pa.record_batch([pa.array(x) for x in (held[0], held[1], size)], names=names)
            if held[2][0] < 0 and band in (0, _RUN):
                yield pa.record_batch([pa.array(x) for x in (held[0], held[1], -size)], names=names)

    return entries.repartition(F.col("bucket")).sortWithinPartitions("bucket", "node").mapInArrow(rows, "bucket long, node long, size int")


def _units(numbered: DataFrame, again: np.ndarray, met: np.ndarray) -> DataFrame:
    """``doc, doc_id, start, end, word, words, node, items``; start and end count UTF-8 bytes."""
    sent = numbered.sparkSession.sparkContext.broadcast((again, met))

    def columns(b, piece, p):
        docs, start, end, word, words, node, items = p.units(*sent.value)
        at = pa.array(docs + piece.first)
        return [b.column("doc").take(at), b.column("doc_id").take(at), start, end, word.astype(np.int32), words.astype(np.int32), node, items]

    id_type = numbered.schema["doc_id"].dataType.simpleString()
    return _map(_narrow(numbered), f"doc long, doc_id {id_type}, start long, end long, word int, words int, node long, items array<long>", columns)


def repeated(numbered: DataFrame, threshold: float = THRESHOLD, run_words: int = 0) -> DataFrame:
    """Paragraphs of classes of two or more; with ``run_words`` those in runs of so many words or more.

    ``numbered`` are documents with row numbers. ``doc, doc_id, start, end, word, words, class, first_doc,
    removed``: ``first_doc`` holds the paragraph that stays; ``removed`` is true where this one goes.
    """
    shared = written(_shared(_entries(numbered)), "par-shared")
    entries = shared.where("size > 0")
    with_items = written(_units(numbered, _bits(shared), _bits(entries)), "par-units")
    sets = written(with_items.where("items is not null").select("node", "items").dropDuplicates(["node"]), "par-sets")
    units = with_items.drop("items")
    linked = link(entries, sets, threshold, "par")

    classed = units.join(linked, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component", "node")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc", "word", "words")
    # Written, so that both sides of the join below are plain shuffles, of which Spark splits the large ones.
    classes = written(classed.groupBy("class").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"), "par-classes")
    over_first = (F.col("doc") == F.col("first.doc")) & (F.col("word") < F.col("first.word") + F.col("first.words"))
    same = classed.join(classes, "class").withColumn("removed", ~over_first)
    marked = written(same.withColumn("first_doc", F.col("first.doc_id")).drop("first", "n"), "par-marked")
    discard(shared, with_items, sets, classes)
    # A class whose members all overlap its first one stands in one place only.
    marked = marked.join(marked.where("removed").select("class").distinct(), "class", "left_semi")
    if not run_words:
        return marked

    def long_runs(rows: DataFrame) -> DataFrame:
        own, to = Window.partitionBy("doc"), F.col("word") + F.col("words")
        in_order = own.orderBy("word", "words", "class")
        reach = F.max(to).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
        run = rows.withColumn("cut", F.when(F.col("word") <= reach, 0).otherwise(1)).withColumn("run", F.sum("cut").over(in_order))
        in_run = Window.partitionBy("doc", "run")
        total = F.max(to).over(in_run) - F.min("word").over(in_run)
        return run.withColumn("total", total).where(F.col("total") >= run_words).drop("cut", "run", "total")

    unit = ["doc", "word", "words", "class"]
    gone = long_runs(marked.where("removed")).select(*unit, F.lit(True).alias("goes"))
    kept = long_runs(marked).drop("removed")
    return kept.join(gone, unit, "left").withColumn("removed", F.coalesce("goes", F.lit(False))).drop("goes")


def dedup_paragraphs(documents: DataFrame, run_words: int = 0) -> DataFrame:
    """The documents without the passages that go, with all their columns."""
    numbered = with_row_numbers(documents)
    before = Window.partitionBy("doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    gone = repeated(numbered, run_words=run_words).where("removed").withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0)))
    between = F.when(F.col("from") < F.col("start"), F.struct("from", F.col("start").alias("to")))  # what stays before this unit
    spans = gone.groupBy(F.col("doc").alias("__of")).agg(F.array_sort(F.collect_set(between)).alias("__stays"), F.max("end").alias("__end"))
    joined = numbered.join(spans, F.col("__doc") == F.col("__of"), "left")
    raw = F.col("text").cast("binary")
    stays = F.array_append("__stays", F.struct(F.col("__end").alias("from"), F.octet_length("text").cast("long").alias("to")))
    pieces = F.transform(stays, lambda x: F.decode(F.substring(raw, x["from"].cast("int") + 1, (x["to"] - x["from"]).cast("int")), "UTF-8"))
    return joined.withColumn("text", F.when(F.col("__end").isNull(), F.col("text")).otherwise(F.array_join(pieces, ""))).select(*documents.columns)


def _covered(spans: Column) -> Column:
    """How many words sorted spans ``(word, to)`` cover; they may overlap."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(a, s):
        return F.struct((a["n"] + F.greatest(F.lit(0), s["to"] - F.greatest(s["word"], a["end"]))).alias("n"), F.greatest(a["end"], s["to"]).alias("end"))

    return F.aggregate(spans, start, add)["n"]


def passages(documents: DataFrame) -> DataFrame:
    """Every document with its repeated and removed passages.

    ``doc_id, n_repeated, n_removed, removed_words, first_docs``: paragraphs in repeated passages, those
    of them that go, the words that these cover, and the ids of the documents that keep them.
    """
    numbered = with_row_numbers(documents.select("doc_id", "text"))
    spans = F.array_sort(F.collect_list(F.when(F.col("removed"), F.struct("word", (F.col("word") + F.col("words")).alias("to")))))
    found = repeated(numbered).groupBy(F.col("doc").alias("__of")).agg(
        F.count("*").alias("n_repeated"),
        F.sum(F.col("removed").cast("long")).alias("n_removed"),
        _covered(spans).cast("long").alias("removed_words"),
        F.array_sort(F.collect_set(F.when(F.col("removed"), F.col("first_doc")))).alias("first_docs"),
    )
    none = F.array().cast(f"array<{documents.schema['doc_id'].dataType.simpleString()}>")
    return numbered.join(found, F.col("__doc") == F.col("__of"), "left").select(
        "doc_id",
        F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"),
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("removed_words", F.lit(0)).alias("removed_words"),
        F.coalesce("first_docs", none).alias("first_docs"),
    )


def op6_paragraph_dedup(spark, sf_dir: str) -> DataFrame:
    """:func:`passages` of all documents."""
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
