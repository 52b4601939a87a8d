"""Toxicity scores by weak supervision.

Voters are words (a lexicon) and word beginnings of 4 to 6 bytes (patterns). Besides a seed lexicon they
are mined from labelled documents: features that toxic documents hold more often than others, by a two-
sample z statistic. A generative label model then estimates by EM how often each voter fires in toxic and
in clean documents, and how far voters fire together; a voter that repeats what others say is weighed
down by its correlations. The given label is one more voter of the model. A logistic regression is fitted
to the posterior labels, with classes weighed as they occur among all labelled rows, and scores texts.

At most ``SAMPLE`` labelled rows of each class, the first by a hash of their id, are used to mine and to
fit (the documented bound of the sample). Scoring reads every whole text once and shuffles nothing.

Edge cases: null and empty texts have no features and get the base score; labels that are null are
ignored, a repeated id counts once and as toxic if any of its rows says so; without labelled rows the seed
lexicon alone decides; ids, languages and sources are never inputs; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import written
from ruleloom.llm.textops import Slice, mix, slices

SAMPLE, VOTERS, MIN_Z, PREFIXES, RENEW = 6_000, 1_024, 5.0, (4, 5, 6), 10
_ROWS = 1_024
#: Common English insults; they vote whether or not the labelled rows hold them.
SEED_LEXICON = ("idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "scum", "pathetic", "worthless", "disgusting", "imbecile", "dumbass", "bastard")


def held_out(doc_id: Column) -> Column:
    """Documents whose crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _features(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes and document numbers: every word, and its first 4, 5 and 6 bytes where it has more."""
    low = piece.lowered()
    starts, ends, docs = low.words("alnum")
    out, of = [low.hashes(starts, ends)], [docs]
    for n in PREFIXES:
        longer = ends - starts >= n
        s = starts[longer]
        out.append(mix(low.hashes(s, s + n) + np.uint64(n)))
        of.append(docs[longer])
    return np.concatenate(out), np.concatenate(of)


def _present(piece: Slice, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, voter) pairs of a slice; ``table`` holds the voters' hashes in order."""
    if not len(table):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, docs = _features(piece)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    hit = table[at] == h
    pairs = np.unique(docs[hit] * len(table) + at[hit])
    return pairs // len(table), pairs % len(table)


def _seed() -> np.ndarray:
    piece = next(slices(pa.array(SEED_LEXICON)))
    starts, ends, _ = piece.words("alnum")
    return piece.hashes(starts, ends)


def sample(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """``text, toxic`` of the bounded sample, and the number of all labelled rows of each class.

    A labelled id gives one text, the smallest, however often it occurs.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {int(r.toxic): int(r["count"]) for r in usable.groupBy("toxic").count().collect()}
    first = [usable.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for c in (0, 1)]
    few = F.broadcast(first[0].unionByName(first[1]).withColumnRenamed("doc_id", "label_id"))  # at most 2 x SAMPLE rows
    taken = documents.join(few, F.col("doc_id") == F.col("label_id"))
    return taken.groupBy("label_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).drop("label_id"), sizes


def mine(labelled: DataFrame) -> np.ndarray:
    """Hashes of the features that tell toxic documents, the strongest ``VOTERS`` of them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = b.column("toxic").to_numpy(zero_copy_only=False)
            for piece in slices(b.column("text")):
                h, docs = _features(piece)
                order = np.lexsort((docs, h))
                h, docs = h[order], docs[order]
                new = np.append(True, (h[1:] != h[:-1]) | (docs[1:] != docs[:-1])) if len(h) else np.zeros(0, bool)
                h, y = h[new], toxic[piece.first + docs[new]]
                keys, at = np.unique(h, return_inverse=True)
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(np.bincount(at, y, len(keys)).astype(np.int64)), pa.array(np.bincount(at, 1 - y, len(keys)).astype(np.int64))], names=["feature", "pos", "neg"])

    totals = labelled.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    pos, neg = int(totals[0]), int(totals[1] - totals[0])
    if not pos or not neg:
        return np.zeros(0, np.uint64)
    counts = labelled.mapInArrow(rows, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    share = (F.col("pos") + F.col("neg")) / float(pos + neg)
    z = (F.col("pos") / float(pos) - F.col("neg") / float(neg)) / F.sqrt(share * (1 - share + 1e-9) * (1 / pos + 1 / neg))
    best = counts.withColumn("z", z).where((F.col("z") >= MIN_Z) & (F.col("pos") >= 2)).orderBy(F.desc("z"), "feature").limit(VOTERS)
    return np.array([r.feature for r in best.select("feature").collect()], np.int64).view(np.uint64)


def _times(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``x @ v`` in blocks of rows, so that small integers don't become a matrix of doubles."""
    return np.concatenate([x[i : i + _ROWS] @ v for i in range(0, len(x), _ROWS)])


def _summed(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``w @ x`` in blocks of rows."""
    return sum(w[i : i + _ROWS] @ x[i : i + _ROWS] for i in range(0, len(x), _ROWS))


def _correlations(votes: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Absolute correlations of the voters over weighted rows."""
    cov = np.zeros((len(mean), len(mean)))
    for i in range(0, len(votes), _ROWS):
        centred = (votes[i : i + _ROWS] - mean) * np.sqrt(weight[i : i + _ROWS])[:, None]
        cov += centred.T @ centred
    scale = np.sqrt(np.diag(cov)) + 1e-9
    cov /= scale[:, None]
    cov /= scale[None, :]
    rho = np.abs(cov, out=cov)
    np.fill_diagonal(rho, 1.0)
    return rho


def label_model(votes: np.ndarray, given: np.ndarray, weight: np.ndarray, rounds: int = 120) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posterior of the toxic class for each row of a 0/1 vote matrix, and the model's estimates.

    ``fires_toxic`` and ``fires_clean`` are each voter's firing rates, ``independence`` its weight: one
    over the sum of its correlations, within the toxic class, with all voters. Correlations are estimated
    anew every ``RENEW`` rounds, until the posterior changes no more: as long as wrong labels mix the
    classes, all voters look correlated.
    """
    p, independence = np.where(given == 1, 0.95, 0.05), np.ones(votes.shape[1])
    for i in range(rounds):
        w1, w0 = p * weight, (1 - p) * weight
        a = (_summed(w1, votes) + 0.5) / (w1.sum() + 1)
        b = (_summed(w0, votes) + 0.5) / (w0.sum() + 1)
        if i % RENEW == 0:
            rho = _correlations(votes, a, w1)
            independence = 1.0 / np.where(rho > 0.2, rho, 0).sum(1)
        good = np.clip([(w1 @ given + 1) / (w1.sum() + 2), (w0 @ given + 1) / (w0.sum() + 2)], 0.005, 0.995)
        logit = np.log(w1.sum() + 1) - np.log(w0.sum() + 1)
        logit = logit + _times(votes, independence * (np.log(a / b) - np.log((1 - a) / (1 - b)))) + (independence * np.log((1 - a) / (1 - b))).sum()
        logit = logit + np.where(given == 1, np.log(good[0] / good[1]), np.log((1 - good[0]) / (1 - good[1])))
        before, p = p, 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if i % RENEW == RENEW - 1 and np.abs(p - before).mean() < 1e-5:
            break
    return p, {"fires_toxic": a, "fires_clean": b, "independence": independence}


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on soft labels by accelerated gradient steps."""
    w, bias, vw, vb = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    weight = weight / weight.sum()
    step = 4.0 / (1 + float((weight * _times(x, np.ones(x.shape[1]))).sum()))  # 0 and 1 are their squares
    step = max(step, 0.5)
    for i in range(rounds):
        m = i / (i + 3)
        aw, ab = w + m * vw, bias + m * vb
        g = weight * (1 / (1 + np.exp(-np.clip(_times(x, aw) + ab, -30, 30))) - y)
        nw, nb = aw - step * (_summed(g, x) + ridge * aw / max(1, len(y) ** 0.5)), ab - step * g.sum()
        vw, vb, w, bias = nw - w, nb - bias, nw, nb
    return w, bias


def fit(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Voter hashes in order, their weights, and the bias."""
    labelled, sizes = sample(documents, labels)
    labelled = written(labelled, "toxicity-sample")
    table = np.unique(np.concatenate([mine(labelled), _seed()]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b.column("text")):
                docs, voter = _present(piece, table)
                cut = np.searchsorted(docs, np.arange(piece.n + 1)).astype(np.int32)
                yield pa.record_batch([b.column("toxic").slice(piece.first, piece.n), pa.ListArray.from_arrays(pa.array(cut), pa.array(voter.astype(np.int32)))], names=["toxic", "fired"])

    got = labelled.mapInArrow(rows, "toxic int, fired array<int>").toPandas()
    y = got.toxic.to_numpy(np.float64)
    if not (0 < y.sum() < len(y)):
        return table, np.where(np.isin(table, _seed()), 6.0, 0.0), -3.0
    votes = np.zeros((len(y), len(table)), np.uint8)
    for i, fired in enumerate(got.fired):
        votes[i, fired] = 1
    taken = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.where(y == 1, sizes.get(1, 1) / taken[1], sizes.get(0, 1) / taken[0])
    weight = weight / weight.mean()
    posterior, _ = label_model(votes, y, weight)
    coefficients, bias = logistic(votes, posterior, weight)
    coefficients = np.where(np.isin(table, _seed()) & (votes.sum(0) == 0), 4.0, coefficients)  # seeds that the sample lacks
    return table, coefficients, float(bias)


def _score_of(piece: Slice, table: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    docs, voter = _present(piece, table)
    return 1 / (1 + np.exp(-np.clip(bias + np.bincount(docs, weights[voter], minlength=piece.n), -30, 30)))


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, score`` with one row per document."""
    documents = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    model = fit(documents, labels)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b.column("text")):
                yield pa.record_batch([b.column("doc_id").slice(piece.first, piece.n), pa.array(_score_of(piece, *model))], names=["doc_id", "score"])

    return documents.mapInArrow(rows, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double")


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below 0.5, with all their columns."""
    model = fit(documents.select("doc_id", F.col("text").cast("string").alias("text")), labels)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b.column("text")):
                yield b.slice(piece.first, piece.n).filter(pa.array(_score_of(piece, *model) < 0.5))

    return documents.mapInArrow(rows, documents.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract columns over all documents."""
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = scores(documents, labels)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
