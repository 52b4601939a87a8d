"""The pipeline against plain versions of its stages, on a small folder of tables."""

import random

import pytest
from brute import classes, contamination, line_dedup, targets, tokens, words
from test_operators import VOCABULARY, prose

import corpus_pipeline
from ruleloom.llm import toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, out = random.Random(11), tmp_path_factory.mktemp("tables")
    texts = [prose(rng, rng.randint(20, 90)) for _ in range(160)]
    leak = " ".join(VOCABULARY[30:44])
    for i in range(0, 160, 8):
        texts[i] += " you grubbit snarfer and grubbit again snarfer"
    texts[3] += " " + leak
    texts[5] = texts[4] + " tail"
    texts[7] = texts[6]
    texts += [None, "", "one line that is said here in ten words twice", "one line that is said here in eleven words twice\nother"]
    docs = [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([("b", leak)], "item_id string, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), docs


def test_pipeline(spark, folder):
    path, docs = folder
    labels = spark.read.parquet(f"{path}/labels.parquet")
    scores = {r.doc_id: r.score for r in toxicity.scores(spark.read.parquet(f"{path}/documents.parquet"), labels).collect()}
    now = [d for d in docs if scores[d[0]] < 0.5]
    assert {d[0] for d in docs} - {d[0] for d in now} == set(range(0, 160, 8))
    lines = line_dedup([(d[0], d[1]) for d in now])
    before = {d[0]: d[1] for d in now}
    now = [(d[0], d[1] if not d[1] else "\n".join(lines[d[0]]), *d[2:]) for d in now]
    now = [d for d in now if words(d[1]) or not words(before[d[0]])]
    group = classes([d[1] for d in now])
    now = [d for i, d in enumerate(now) if group[i] == i]
    now = [d for d in now if contamination(d[1], [("b", " ".join(VOCABULARY[30:44]))])[1] == 0]
    got = corpus_pipeline.run(spark, path).collect()
    copies = {}
    for r in got:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        assert r.text == {d[0]: d[1] for d in now}[r.doc_id]
    sizes, taken = {}, {}
    for d in now:
        n = len(tokens(d[1]))
        sizes[d[3]] = sizes.get(d[3], 0) + n
        taken[d[3]] = taken.get(d[3], 0) + n * copies.get(d[0], 0)
    for s, t in targets(sizes).items():
        assert abs(taken[s] - t) <= 0.02 * t
    assert set(copies) <= {d[0] for d in now} and max(copies.values()) <= 2


def test_stages_keep_the_columns(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.dtypes == docs.dtypes
        docs = out.limit(0)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() == 0
