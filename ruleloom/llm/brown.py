"""Language-model scoring with Brown classes.

The score of a text is the sum over its tokens of ``log10 P(class | previous class) + log10 P(token |
class)``. All counts come from all training documents. Classes come from exchange clustering: items
move, one at a time, to the class that raises the likelihood of the class bigrams most. An item is one
of the ``FREQUENT`` most frequent words, or one of ``ENDINGS`` groups that the other words fall into by
their last three bytes; so every word of any corpus has a class, and the matrix that the clustering
reads has a fixed size. Then each further word of the ``KNOWN`` most frequent ones moves to the class of
highest gain, on its own: Spark counts the classes before and after it and compares the gains, all words
against the same classes. Rarer words keep the class of their ending. The class bigrams are counted anew
with the classes that come out. Both probabilities are smoothed by adding 0.5, and each class keeps room for
one unseen word.

Spark counts words (one shuffle of partial counts) and item pairs, and looks up the counts at scoring:
those of the ``KNOWN`` most frequent words travel with the tasks, all others meet their tokens in a join
on the word's hash. Words are told apart by 64-bit hashes.

Edge cases: a null or empty text is its end token alone; a null id counts as the id ``''`` for the split
into training and held-out documents; repeated rows are scored, and counted, each; with no training
documents every token is unseen; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import written
from ruleloom.llm.textops import slices

FREQUENT, ENDINGS, CLASSES, KNOWN, ROUNDS = 1024, 512, 48, 200_000, 8
END = FREQUENT + ENDINGS  # the item of the end token
ITEMS = END + 1
_FLUSH = 1_000_000


def held_out(doc_id: Column) -> Column:
    """Documents whose crc32 of the id as text leaves 1 when divided by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 1


def _tokens(piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, ending group and document number of each word of a slice."""
    low = piece.lowered()
    starts, ends, docs = low.words("space")
    return low.hashes(starts, ends), (low.hashes(np.maximum(starts, ends - 3), ends) % np.uint64(ENDINGS)).astype(np.int64), docs


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each stands first, and their sums."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], order[first], np.add.reduceat(n, first) if len(first) else n


def word_counts(training: DataFrame) -> DataFrame:
    """``word long, ending int, n long``: every distinct word's hash, ending group and count."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged():
            h, e, n = (np.concatenate(x) for x in zip(*held, strict=True))
            h, first, n = _summed(h, n)
            return h, e[first], n

        def batch(h, e, n):
            return pa.record_batch([pa.array(h.view(np.int64)), pa.array(e.astype(np.int32)), pa.array(n)], names=["word", "ending", "n"])

        for b in batches:
            for piece in slices(b.column("text")):
                h, e, _ = _tokens(piece)
                h, first, n = _summed(h, np.ones(len(h), np.int64))
                held.append((h, e[first], n))
                if sum(len(x[0]) for x in held) > _FLUSH:
                    held = [merged()]
                    if len(held[0][0]) > _FLUSH // 2:
                        yield batch(*held[0])
                        held = []
        if held:
            yield batch(*merged())

    return training.select("text").mapInArrow(rows, "word long, ending int, n long").groupBy("word", "ending").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """What the tasks need; its size is bounded by the constants above."""

    words: np.ndarray  # sorted hashes of the most frequent words
    counts: np.ndarray
    items: np.ndarray
    endings: np.ndarray
    n: int
    v: int
    ends: int
    own: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # the class of each of these words
    classes: np.ndarray = field(default_factory=lambda: np.zeros(ITEMS, np.int64))
    transition: np.ndarray = field(default_factory=lambda: np.zeros((CLASSES, CLASSES)))
    size: np.ndarray = field(default_factory=lambda: np.ones(CLASSES))  # N_c + 0.5 (V_c + 1)

    def look_up(self, h: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (-1: not among the most frequent) and item of each word."""
        if not len(self.words):
            return np.full(len(h), -1), FREQUENT + endings
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        known = self.words[at] == h
        return np.where(known, self.counts[at], -1), np.where(known, self.items[at], FREQUENT + endings)


    def classes_of(self, h: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index among the most frequent words (-1: not one), count and class of each word."""
        by_ending = self.classes[FREQUENT:END][endings]
        if not len(self.words):
            return np.full(len(h), -1), np.full(len(h), -1), by_ending
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        known = self.words[at] == h
        return np.where(known, at, -1), np.where(known, self.counts[at], -1), np.where(known, self.own[at], by_ending)


def pair_counts(training: DataFrame, model) -> DataFrame:
    """``pair long, n long`` for pairs of neighbouring items; a text stands between two end tokens."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ITEMS * ITEMS, np.int64)
        for b in batches:
            for piece in slices(b.column("text")):
                h, endings, docs = _tokens(piece)
                _, item = model.value.look_up(h, endings)
                before, after, _ = _between_ends(item, docs, piece.n)
                total += np.bincount(before * ITEMS + after, minlength=ITEMS * ITEMS)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 18):
            yield pa.record_batch([pa.array(at[i : i + (1 << 18)]), pa.array(total[at[i : i + (1 << 18)]])], names=["pair", "n"])

    return training.select("text").mapInArrow(rows, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _between_ends(item: np.ndarray, docs: np.ndarray, n: int, end: int = END) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token with the one before it and its document, an end token closing every document."""
    at = np.searchsorted(docs, np.arange(n), "right")
    after = np.insert(item, at, end)
    of = np.insert(docs, at, np.arange(n))
    before = np.append(end, after[:-1])
    return before, after, of


def class_counts(training: DataFrame, model) -> np.ndarray:
    """How often each class follows each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for b in batches:
            for piece in slices(b.column("text")):
                h, endings, docs = _tokens(piece)
                before, after, _ = _between_ends(model.value.classes_of(h, endings)[2], docs, piece.n, int(model.value.classes[END]))
                total += np.bincount(before * CLASSES + after, minlength=CLASSES * CLASSES)
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], names=["pair", "n"])

    at, n = _columns(training.select("text").mapInArrow(rows, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair", "n")
    out = np.zeros(CLASSES * CLASSES, np.int64)
    out[at] = n
    return out.reshape(CLASSES, CLASSES)


def neighbours(training: DataFrame, model) -> DataFrame:
    """``word, side, n``: how often a class stands before (``side`` below ``CLASSES``) or after a word that may move."""

    def batch(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array((key // (2 * CLASSES)).astype(np.int32)), pa.array((key % (2 * CLASSES)).astype(np.int32)), pa.array(n)], names=["word", "side", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for b in batches:
            for piece in slices(b.column("text")):
                h, endings, docs = _tokens(piece)
                at, _, cls = m.classes_of(h, endings)
                moves = (at >= 0) & (m.items[at] >= FREQUENT) if len(m.items) else at >= 0
                end = int(m.classes[END])
                before, _, _ = _between_ends(cls, docs, piece.n, end)
                token = (np.arange(len(cls)) + docs)[moves]  # where the words stand among the tokens with ends
                follows = np.append(before[2:], [end, end])[token]  # the class of the next token
                key = np.concatenate([at[moves] * 2 * CLASSES + before[token], at[moves] * 2 * CLASSES + CLASSES + follows])
                key, _, n = _summed(np.append(held[0], key), np.append(held[1], np.ones(len(key), np.int64)))
                held = [key, n]
                if len(key) > _FLUSH:
                    yield batch(*held)
                    held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        yield batch(*held)

    return training.select("text").mapInArrow(rows, "word int, side int, n long").groupBy("word", "side").agg(F.sum("n").alias("n"))


def gains(table: np.ndarray, sides: np.ndarray, n: np.ndarray, of: np.ndarray, words: int, now: np.ndarray) -> np.ndarray:
    """What each word adds to the likelihood in each class, itself taken out of the class where it is ``now``.

    ``sides, n, of`` list the counts of the classes around the words: a class before a word, or ``CLASSES`` plus
    the class after it, its count and the word.
    """

    def f(x):
        return x * np.log(np.maximum(x, 1))

    out = np.zeros((words, CLASSES))
    total = [np.zeros(words), np.zeros(words)]
    rows, cols = table.sum(1), table.sum(0)
    for first in range(0, len(of), 65_536):
        part = slice(first, first + 65_536)
        after = sides[part] >= CLASSES
        c, w, x = sides[part] % CLASSES, of[part], n[part].astype(np.float64)
        cell = np.where(after[:, None], table[:, c].T, table[c, :]).astype(np.float64)
        own = np.arange(CLASSES)[None, :] == now[w][:, None]
        cell = np.maximum(cell - own * x[:, None], 0)
        np.add.at(out, w, f(cell + x[:, None]) - f(cell))
        np.add.at(total[1], w[after], x[after])
        np.add.at(total[0], w[~after], x[~after])
    for side, sums in ((0, cols), (1, rows)):
        own = np.arange(CLASSES)[None, :] == now[:, None]
        without = np.maximum(sums[None, :] - own * total[side][:, None], 0)
        out -= f(without + total[side][:, None]) - f(without)
    return out


def moved(around: DataFrame, table: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and the class of highest gain of each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, lists = b.column("word").to_numpy(), b.column("around")
            offsets = np.asarray(lists.offsets)
            of = np.repeat(np.arange(len(word)), np.diff(offsets))
            flat = lists.flatten()
            best = gains(table, flat.field("side").to_numpy(), flat.field("n").to_numpy(), of, len(word), own[word])
            best[np.arange(len(word)), own[word]] += 1e-9
            yield pa.record_batch([b.column("word"), pa.array(best.argmax(1).astype(np.int32))], names=["word", "class"])

    lists = around.groupBy("word").agg(F.collect_list(F.struct("side", "n")).alias("around"))  # 2 * CLASSES at most
    return tuple(_columns(lists.mapInArrow(rows, "word int, class int"), "word", "class"))


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Exchange clustering of items by their pair counts; items are dealt out by frequency at first."""
    k = len(pairs)
    m = pairs.astype(np.float64)
    order = np.argsort(-(m.sum(0) + m.sum(1)), kind="stable")
    of = np.zeros(k, np.int64)
    of[order] = np.arange(k) % classes
    member = np.eye(classes)[of]
    left, right = m.T @ member, m @ member  # of each item: counts with the class before, after it
    table = member.T @ m @ member

    def f(x):
        return x * np.log(np.maximum(x, 1))

    for _ in range(rounds):
        moved = 0
        for w in order:
            a, self_n = of[w], m[w, w]
            r, l = right[w].copy(), left[w].copy()
            r[a] -= self_n
            l[a] -= self_n
            total_r, total_l = r.sum() + self_n, l.sum() + self_n
            if total_r + total_l == 0:
                continue
            table[a, :] -= r
            table[:, a] -= l
            table[a, a] -= self_n
            rows, cols = table.sum(1), table.sum(0)
            gain = (f(table + r[None, :]) - f(table)).sum(1) + (f(table + l[:, None]) - f(table)).sum(0)
            d = np.diag(table)
            gain += f(d + r + l + self_n) - f(d + r) - f(d + l) + f(d)
            gain -= f(rows + total_r) - f(rows) + f(cols + total_l) - f(cols)
            b = int(np.argmax(gain + 1e-9 * (np.arange(classes) == a)))
            table[b, :] += r
            table[:, b] += l
            table[b, b] += self_n
            if b != a:
                moved += 1
                of[w] = b
                left[:, a] -= m[w]
                left[:, b] += m[w]
                right[:, a] -= m[:, w]
                right[:, b] += m[:, w]
        if not moved:
            break
    return of


def _columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of a bounded result as 64-bit integers; Arrow holds them in a fraction of what rows take."""
    table = df.select(*names).toArrow()
    return [table.column(c).to_numpy().astype(np.int64) for c in names]


def train(training: DataFrame) -> tuple[Model, DataFrame]:
    """The model and the table of all word counts."""
    spark = training.sparkSession
    counts = written(word_counts(training), "lm-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = training.count()
    word, ending, n = _columns(counts.orderBy(F.desc("n"), "word").limit(KNOWN), "word", "ending", "n")
    word = word.view(np.uint64)
    item = np.where(np.arange(len(word)) < FREQUENT, np.arange(len(word)), FREQUENT + ending)
    order = np.argsort(word)
    word, n, item, ending = word[order], n[order], item[order], ending[order]
    model = Model(word, n, item, ending, int(total[0]) + ends, int(total[1]) + (ends > 0), ends)
    pairs = np.zeros(ITEMS * ITEMS, np.int64)
    at, times = _columns(pair_counts(training, spark.sparkContext.broadcast(model)), "pair", "n")
    pairs[at] = times
    pairs = pairs.reshape(ITEMS, ITEMS)
    model.classes = of = exchange(pairs)
    member = np.eye(CLASSES)[of]
    table = member.T @ pairs @ member
    del pairs
    model.own = of[item]
    which, to = moved(neighbours(training, spark.sparkContext.broadcast(model)), table, model.own)
    model.own[which] = to
    table = class_counts(training, spark.sparkContext.broadcast(model))
    model.transition = np.log10((table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * CLASSES))
    # Words and tokens of each class: the most frequent words by their own class, the others by their ending's.
    ends_at, ends_v, ends_n = _columns(counts.groupBy("ending").agg(F.count("*").alias("v"), F.sum("n").alias("n")), "ending", "v", "n")
    rest_v, rest_n = np.zeros(ENDINGS), np.zeros(ENDINGS)
    rest_v[ends_at], rest_n[ends_at] = ends_v, ends_n
    by_ending = of[FREQUENT:END]
    rest_v -= np.bincount(ending, minlength=ENDINGS)
    rest_n -= np.bincount(ending, n, ENDINGS)
    types = np.bincount(model.own, minlength=CLASSES) + np.bincount(by_ending, rest_v, CLASSES)
    mass = np.bincount(model.own, n, CLASSES) + np.bincount(by_ending, rest_n, CLASSES)
    types[of[END]] += ends > 0
    mass[of[END]] += ends
    model.size = mass + 0.5 * (types + 1)
    return model, counts


_PARTIAL = "held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<word: long, kind: int, tf: long>>"


def _score_known(documents: DataFrame, model, id_type: str) -> DataFrame:
    """Sums over end tokens, transitions and the most frequent words; the other words in ``rare``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        base_size = np.log10(m.n + 0.5 * (m.v + 1))
        log_size = np.log10(m.size)
        for b in batches:
            rest = b.drop_columns(["text"])
            for piece in slices(b.column("text")):
                h, endings, docs = _tokens(piece)
                _, c, cls = m.classes_of(h, endings)
                before, after, of = _between_ends(cls, docs, piece.n, int(m.classes[END]))
                add = lambda at, x: np.bincount(at, x, minlength=piece.n)
                score = add(of, m.transition[before, after])
                known = c >= 0
                log_c = np.log10(c[known] + 0.5)
                score += add(docs[known], log_c - log_size[cls[known]]) + np.log10(m.ends + 0.5) - log_size[m.classes[END]]
                base = add(docs[known], log_c - base_size) + np.log10(m.ends + 0.5) - base_size
                rare = np.flatnonzero(~known)
                rare = rare[np.lexsort((h[rare], docs[rare]))]
                new = np.append(True, (h[rare][1:] != h[rare][:-1]) | (docs[rare][1:] != docs[rare][:-1])) if len(rare) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                tf = np.diff(np.append(first, len(rare)))
                one = rare[first]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(docs[one], np.arange(piece.n + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(h[one].view(np.int64)), pa.array(cls[one].astype(np.int32)), pa.array(tf.astype(np.int64))], ["word", "kind", "tf"]),
                )
                part = rest.slice(piece.first, piece.n)
                n = np.bincount(docs, minlength=piece.n) + 1
                n_known = np.bincount(docs[known], minlength=piece.n) + (m.ends > 0)
                out = [part.column("doc_id"), part.column("held_out"), pa.array(n.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(score), lists]
                yield pa.record_batch(out, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])

    return documents.mapInArrow(rows, f"doc_id {id_type}, {_PARTIAL}")


def score(documents: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``."""
    spark = documents.sparkSession
    documents = documents.select("doc_id", F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    id_type = documents.schema["doc_id"].dataType.simpleString()
    model, counts = train(documents.where(~F.col("held_out")))
    partial = _score_known(documents, spark.sparkContext.broadcast(model), id_type).withColumn("row", F.monotonically_increasing_id())
    partial = written(partial, "lm-partial")
    base_size = float(np.log10(model.n + 0.5 * (model.v + 1)))
    log_size = F.array(*[F.lit(float(x)) for x in np.log10(model.size)])
    rare = partial.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.kind", "x.tf")
    joined = rare.join(counts.select("word", "n"), "word", "left")
    log_c = F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    more = joined.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("more_known"),
        F.sum(F.col("tf") * (log_c - base_size)).alias("more_base"),
        F.sum(F.col("tf") * (log_c - F.element_at(log_size, F.col("kind") + 1))).alias("more_score"),
    )
    total = partial.drop("rare").join(more, "row", "left")
    scored = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return total.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        scored.alias("score"),
        F.pow(F.lit(10.0), -scored / F.col("n_tokens")).alias("perplexity"),
    )


def op10_brown_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Contract columns, and the perplexity, over all documents."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
