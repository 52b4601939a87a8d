"""Each corpus operator against its plain version, over nulls, empty and long texts, ties, repeats and extra columns."""

import math
import random

import pytest
from brute import LOWER, base_license, base_scores, classes, contamination, crc, later_bytes, line_dedup, nearest, repeated_bytes, targets, tokens, words
from pyspark.sql import functions as F

from ruleloom.llm import bagminhash, brown, decontaminate, licenses, linededup, mixing, multiindex, paragraphs, suffixdedup, toxicity

SCHEMA = "doc_id long, text string, source string, class string, row long, n long"
VOCABULARY = [a + b for a in "ba ke li mo nu ra so ti vu ze".split() for b in "ben dor fal gim hus jal kor lim mas nep".split()]


def prose(rng, n):
    out = []
    while len(out) < n:
        sentence = [rng.choice(VOCABULARY) for _ in range(min(rng.randint(6, 14), n - len(out)))]
        out.append(sentence[0].capitalize() + " " + " ".join(sentence[1:]) + rng.choice([".", ".", ".\n"]))
        out += [""] * (len(sentence) - 1)
    return " ".join(x for x in out if x).replace("\n ", "\n")


def corpus():
    rng = random.Random(7)
    texts = [None, "", " \n\t ", "word", "one two three", "ÄÖ über 漢字 naïve café"]
    texts += [prose(rng, rng.randint(5, 120)) for _ in range(24)]
    long = prose(rng, 1500)
    shared = prose(rng, 70)
    texts += [long, long + " and a few words more", long]
    texts += [prose(rng, 60) + " " + shared + " " + prose(rng, 60) for _ in range(3)]
    near = prose(rng, 100).split()
    for i in range(6):
        w = list(near)
        w[i * 9] = "changed"
        texts.append(" ".join(w))
    texts += ["Released under the MIT License.\nmit license, MIT-License!", "see the Apache License and the GNU General Public License; general public license"]
    line = "this line of nine words is said again here"
    texts += [line, line.replace("nine", "ten"), line + " now\n" + line, "short line\nshort line\nother", "Short line!"]
    return [(i, t, ["a", "b", "c", None][i % 4] if i % 3 else "a", f"c{i}", i % 2, -i) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_license_scan(docs, rows, none):
    found = by_id(licenses.scan(docs))
    assert len(found) == len(rows)
    for doc_id, text, *_ in rows:
        r = found[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_license(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert licenses.scan(none).count() == 0


def test_license_notice_with_a_missing_word(spark):
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this very software and associated documentation files"
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_base == 0 and r.labels == "mit" and 0.8 <= r.score < 1


def test_license_labels_against_all_windows(spark):
    rng = random.Random(31)
    notices = list(licenses.NOTICES)
    docs = []
    for i in range(120):
        w = rng.choice(notices).split()
        for _ in range(rng.randint(0, 3)):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            w[at : at + (kind != 1)] = [] if kind == 0 else ["other"] * rng.randint(1, 3)
        docs.append((i, " ".join([*prose(rng, 5).split(), *w, *rng.choice(notices).split()[:4]])))
    bsd = next(n for n, label in licenses.NOTICES.items() if label == "bsd").split()
    docs.append((900, " ".join(x for i in range(len(bsd) - 1) for x in (bsd[i], bsd[i + 1], "zig", "zag"))))
    found = by_id(licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")))
    for i, text in docs:
        w, labels, best = words(text), set(), 0.0
        for phrase, label in [*licenses.BASE.items(), *licenses.NOTICES.items()]:
            p = phrase.split()
            n, base = len(p) - 1, phrase in licenses.BASE
            at = {(k - j, j) for j in range(n) for k in range(len(w) - 1) if w[k : k + 2] == p[j : j + 2]}
            share = max((len({j for d, j in at if f <= d <= f + licenses.SLACK}) / n for f, _ in at), default=0)
            whole = any(w[k : k + len(p)] == p for k in range(len(w)))
            if whole if base or n < licenses.FUZZY_FROM else share >= licenses.MIN_SHARE:
                labels.add(label)
                best = max(best, share)
        assert (found[i].labels, found[i].score) == (",".join(sorted(labels)), pytest.approx(best)), text
    assert found[900].labels == ""


BENCHMARK = [("x1", " ".join(VOCABULARY[:14])), ("x2", "three words only"), (None, " ".join(VOCABULARY[20:31])), ("x3", None), ("x4", "..."), ("x1", " ".join(VOCABULARY[:14]))]


@pytest.mark.parametrize("block", [1_000_000, 3])
def test_decontamination(spark, rows, none, block):
    extra = [(900, "Start: " + " ".join(VOCABULARY[2:13]) + " end", "a", "", 0, 0), (901, "three, WORDS only three words", "a", "", 0, 0), (902, " ".join(VOCABULARY[20:31]), "a", "", 0, 0), (903, " ".join(VOCABULARY[:9]), "a", "", 0, 0)]
    every = [*rows, *extra]
    items = spark.createDataFrame(BENCHMARK, "item_id string, text string")
    documents = spark.createDataFrame(every, SCHEMA)
    found = by_id(decontaminate.contamination(documents, items, block).withColumn("digest", F.sha2(F.array_join("items", ","), 256)))
    for doc_id, text, *_ in every:
        r = found[doc_id]
        assert (r.n_words, r.n_hit, r.digest) == contamination(text, BENCHMARK)
    clean = {r.doc_id for r in decontaminate.decontaminate(documents, items, block).collect()}
    assert clean == {i for i, r in found.items() if not r.n_hit}
    assert decontaminate.contamination(none, items, block).count() == 0
    assert decontaminate.contamination(documents, items.limit(0), block).where("n_hit > 0").count() == 0


def test_near_duplicates(docs, rows, none):
    found = by_id(bagminhash.near_duplicates(docs))
    want = classes([r[1] for r in rows])
    assert {i: r.class_id for i, r in found.items()} == dict(enumerate(want))
    kept = sorted(r.doc_id for r in bagminhash.drop_near_duplicates(docs).collect())
    assert kept == sorted(set(want))
    assert bagminhash.near_duplicates(none).count() == 0


def test_near_duplicates_in_a_large_group(spark):
    rng = random.Random(3)
    base = [rng.choice(VOCABULARY) + str(i % 7) for i in range(200)]
    texts = []
    for _ in range(90):
        w = list(base)
        for at in rng.sample(range(200), rng.randint(0, 2)):
            w[at] = "x" + str(rng.randint(0, 9))
        texts.append(" ".join(w))
    found = by_id(bagminhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [found[i].class_id for i in range(90)] == classes(texts)


def test_signatures_estimate_weighted_jaccard():
    import numpy as np

    a, b = {1: 5, 2: 1, 3: 9}, {1: 2, 2: 1, 4: 4}
    h = np.array([*a, *b], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    docs = np.array([0] * 3 + [1] * 3)
    sig = bagminhash.signatures(h, docs, np.array([*a.values(), *b.values()]), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - 3 / 18) < 0.03


def test_paragraphs(docs, rows, none):
    found = {r.doc_id: r for r in paragraphs.dedup_paragraphs(docs).collect()}
    long = [i for i, r in enumerate(rows) if r[1] and len(r[1]) > 5000]
    assert found[long[0]].text == rows[long[0]][1]
    assert all(len(found[i].text) < 0.2 * len(rows[i][1]) for i in long[1:])
    holders = [long[-1] + 1 + i for i in range(3)]
    assert found[holders[0]].text == rows[holders[0]][1]
    assert all(len(words(found[i].text)) <= len(words(rows[i][1])) - 40 for i in holders[1:])
    assert all(found[i].text == rows[i][1] for i in range(24) if i != 6)
    assert paragraphs.dedup_paragraphs(none).count() == 0
    assert paragraphs.bands_for(0.8, 0.99) == 5


def test_paragraphs_with_other_punctuation(spark):
    rng = random.Random(11)
    passages = [[rng.choice(VOCABULARY) for _ in range(50)] for _ in range(40)]
    texts = []
    for w in passages:  # the same words: in sentences of seven, in sentences of eleven, and without any
        for step, tail in ((7, ".%%% "), (11, ".\n"), (99, "")):
            texts.append(prose(rng, 30) + " " + "".join(x + (tail if i % step == step - 1 else " ") for i, x in enumerate(w)) + prose(rng, 30))
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.text for r in paragraphs.dedup_paragraphs(documents).collect()}
    assert all(found[i] == texts[i] for i in range(0, len(texts), 3))
    assert all(len(words(found[i])) <= len(words(texts[i])) - 25 for i in range(len(texts)) if i % 3)


def test_paragraphs_of_one_repeating_text(spark):
    documents = spark.createDataFrame([(0, "again " * 400)], "doc_id long, text string")
    assert len(words(paragraphs.dedup_paragraphs(documents).first().text)) >= paragraphs.CHUNK


def test_paragraphs_of_equal_rows(spark):
    rng = random.Random(51)
    text, other = prose(rng, 60), prose(rng, 60)
    frame = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (2, other, None), (None, None, "z")], "doc_id long, text string, doc string").coalesce(1)
    kept = sorted(len(words(r.text)) for r in paragraphs.dedup_paragraphs(frame).collect())
    assert kept == [0, 0, 60, 60]  # the null text, the copy, and what stays
    found = paragraphs.passages(frame).collect()
    assert sorted((r.n_removed > 0, r.removed_words, r.first_docs) for r in found) == [(False, 0, []), (False, 0, []), (False, 0, []), (True, 60, [1])]
    assert sorted(r.n_repeated > 0 for r in found) == [False, False, True, True]


def test_links_of_many_small_sets_that_share_an_item(spark):
    from ruleloom.llm.links import link

    n = 3_000
    nodes = spark.range(n).select(F.col("id").alias("node"))
    sets = nodes.select("node", F.array(F.lit(-1).cast("long"), F.col("node") + 10_000).alias("items"))
    twins = spark.createDataFrame([(n + i, [-1, 77, 78, 79, 80][: 4 + i]) for i in range(2)], "node long, items array<long>")
    sets = sets.union(twins).cache()
    entries = sets.select(F.lit(1).cast("long").alias("bucket"), "node", F.size("items").alias("size"))
    found = link(entries, sets, 0.8, "test").where("node <> component").collect()
    assert [(r.node, r.component) for r in found] == [(n + 1, n)]


def _classes(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def test_stars_need_no_further_step_and_small_tables_few_files(spark, monkeypatch):
    import random

    from ruleloom.llm import links

    tables = []

    def written(df, name, *rows, write=links.written):
        out = write(df, name, *rows)
        tables.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(links, "written", written)
    monkeypatch.setattr(links, "discard", lambda *tables: None)
    stars = spark.createDataFrame([(1, n) for n in range(2, 30)] + [(31, 30)], "a long, b long")
    assert {r.node: r.component for r in links.components(stars).collect()} == {n: 1 if n < 30 else 30 for n in range(1, 32)}
    assert len(tables) == 1
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(1000 + i, 1001 + i) for i in range(40)]
    pairs = [(a, b) for a, b in pairs if a != b]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        tables.clear()
        found = links.components(spark.createDataFrame(pairs, "a long, b long"), "test", len(pairs)).collect()
        assert max(tables) <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(found) == len({n for pair in pairs for n in pair})
    assert {r.node: r.component for r in found} == _classes({n for pair in pairs for n in pair}, pairs)


def test_links_meet_by_items_of_several_components_only(spark, monkeypatch):
    """Sixty near copies below the threshold, each with ten items of its own, and forty pairs above it."""
    from ruleloom.llm import links

    tables = {}

    def written(df, name, *rows, write=links.written):
        tables[name] = write(df, name, *rows)
        return tables[name]

    monkeypatch.setattr(links, "written", written)
    sets = {n: [*range(40), *range(1000 * n, 1000 * n + 10)] for n in range(1, 61)}
    for n in range(61, 141, 2):
        both = [*range(40), *range(1000 * n, 1000 * n + 8)]
        sets |= {n: [*both, 1000 * n + 10, 1000 * n + 11], n + 1: [*both, 1000 * n + 12, 1000 * n + 13]}
    entries = spark.createDataFrame([(7, n, 50) for n in sets], "bucket long, node long, size long")
    found = links.link(entries, spark.createDataFrame(list(sets.items()), "node long, items array<long>"), 0.8, "test").where("node <> component")
    assert {(r.component, r.node) for r in found.collect()} == {(n, n + 1) for n in range(61, 141, 2)}
    holders = {}
    for items in sets.values():
        for item in items:
            holders[item] = holders.get(item, 0) + 1
    prefix = [r.item for r in tables["test-prefix"].collect()]
    assert prefix and min(holders[item] for item in prefix) > 1
    # Items of over half of the nodes are not joined one by one.
    assert {r.item for r in tables["test-shared"].where("common").collect()} == set(range(40))


def test_items_of_near_copies_become_rows_only_where_these_differ(spark, monkeypatch):
    """A hundred near copies below the threshold that share 160 items, and ten pairs above it; each lacks four of the 160."""
    from ruleloom.llm import links

    tables = {}

    def written(df, name, *rows, write=links.written):
        tables[name] = write(df, name, *rows)
        return tables[name]

    monkeypatch.setattr(links, "written", written)
    rng = random.Random(23)
    sets = {n: [*sorted(rng.sample(range(160), 156)), *range(1000 * n, 1000 * n + 40)] for n in range(1, 101)}
    for n in range(101, 121, 2):
        own = [*range(1000 * n, 1000 * n + 34)]
        sets |= {n: [*range(4, 160), *own, *range(1000 * n + 40, 1000 * n + 46)], n + 1: [*range(156), *own, *range(1000 * n + 50, 1000 * n + 56)]}
    linked = {(a, b) for a in sets for b in sets if a < b and len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})}
    assert linked == {(n, n + 1) for n in range(101, 121, 2)}
    entries = spark.createDataFrame([(7, n, len(items)) for n, items in sets.items()], "bucket long, node long, size long")
    found = links.link(entries, spark.createDataFrame(list(sets.items()), "node long, items array<long>"), 0.8, "test").where("node <> component")
    assert {(r.component, r.node) for r in found.collect()} == linked
    rest = tables["test-rest"].collect()
    assert len(rest) == 40 * len(sets) and min(r.item for r in rest) >= 1000


def test_short_paragraphs(spark):
    rng = random.Random(13)
    notice = "All rights of this text are reserved."  # 7 words
    verse = "\n".join(" ".join(rng.choice(VOCABULARY) for _ in range(4)) for _ in range(15))
    texts = [f"{prose(rng, 30)}\n{notice}\n{prose(rng, 30)}" for _ in range(4)]
    texts += [verse, verse, "A short text copied whole, of nine words", "A short text copied whole, of nine words!", "Thank you", "thank you!"]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.text for r in paragraphs.dedup_paragraphs(documents).collect()}
    assert all(found[i] == texts[i] for i in (0, 4, 6, 8))
    assert all(words(found[i]) == words(texts[i].replace(notice, "")) for i in (1, 2, 3))
    assert [words(found[i]) for i in (7, 9)] == [[], []]
    assert not words(found[5])
    kept = {r.doc_id: r.text for r in paragraphs.dedup_paragraphs(documents, run_words=20).collect()}
    assert all(kept[i] == texts[i] for i in range(len(texts)) if i != 5) and not words(kept[5])


@pytest.mark.parametrize("heavy, hot", [(5_000, 5_000), (200_000, 5_000), (5_000, 1), (200_000, 1)])
def test_substrings(docs, rows, none, monkeypatch, heavy, hot):
    monkeypatch.setattr(suffixdedup, "HEAVY", heavy)  # with the larger number every anchor counts as heavy
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    numbered = suffixdedup._numbered(docs)
    found = by_id(suffixdedup._without(docs, numbered, suffixdedup.repeated_bytes(numbered), False))
    for (doc_id, *_), want in zip(rows, repeated_bytes([r[1] for r in rows]), strict=True):
        r = found[doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want
    first = by_id(suffixdedup.dedup_substrings(docs))
    assert {i: first[i].n_removed for i in first} == dict(enumerate(later_bytes([r[1] for r in rows])))
    assert suffixdedup.dedup_substrings(none).count() == 0


def test_substrings_of_equal_rows(spark):
    text = prose(random.Random(21), 90)
    frame = spark.createDataFrame([(1, text), (1, text), (2, "other")], "doc_id long, text string").coalesce(1)
    assert sorted(r.n_removed for r in suffixdedup.dedup_substrings(frame).collect()) == [0, 0, len(text.encode())]


def test_substrings_of_a_long_text(spark):
    text = random.Random(22).randbytes(2_600_000).hex()  # longer than two pieces
    passage = text[suffixdedup.PIECE - 150 : suffixdedup.PIECE + 300]
    frame = spark.createDataFrame([(1, text), (2, "before " + passage + " after")], "doc_id long, text string")
    found = by_id(suffixdedup.op7_columns(frame))
    assert [(found[i].n_removed, found[i].n_spans) for i in (1, 2)] == [(450, 1), (450, 1)]


def test_suffix_order():
    import numpy as np

    rng = random.Random(23)
    text = bytes(rng.choice(b"ab") for _ in range(40)) * 12 + bytes(rng.choice(b"abc") for _ in range(300)) + b"\x00" * 260
    starts = np.arange(0, len(text) - suffixdedup.LENGTH + 1)
    got = suffixdedup.SuffixOrder(np.frombuffer(text, np.uint8), starts)
    part = [text[i : i + suffixdedup.LENGTH] for i in starts]
    assert got.order.tolist() == sorted(range(len(starts)), key=lambda i: (part[i], i))
    r, s = np.array([rng.randrange(len(starts)) for _ in range(500)]), np.array([rng.randrange(len(starts)) for _ in range(500)])
    want = [next((k for k in range(200) if part[i][k] != part[j][k]), 200) for i, j in zip(got.order[r], got.order[s], strict=True)]
    assert got.common(r, s).tolist() == want


def test_substrings_of_one_repeating_text(spark):
    texts = ["ab" * 400, "x" * 199, "y" * 201, "ab" * 150 + "é" * 150, None]
    frame = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    numbered = suffixdedup._numbered(frame)
    found = suffixdedup._without(frame, numbered, suffixdedup.repeated_bytes(numbered), False).collect()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    assert got == sorted((i, *x) for i, x in zip([0, 1, 2, 3, 4, 0], repeated_bytes([*texts, texts[0]]), strict=True))


def test_longest_previous_factors():
    import numpy as np

    text = "abracadabra"
    order = np.array(sorted(range(len(text)), key=lambda i: text[i:]))

    def common(r, s):
        out = []
        for i, j in zip(order[r], order[s], strict=True):
            n = 0
            while max(i, j) + n < len(text) and text[i + n] == text[j + n]:
                n += 1
            out.append(n)
        return np.array(out)

    lpf, _ = suffixdedup.longest_previous(order, common)
    assert lpf.tolist() == [max([n for j in range(i) for n in range(len(text) - i + 1) if text[j : j + n] == text[i : i + n]], default=0) for i in range(len(text))]


def test_line_dedup(docs, rows, none):
    want = line_dedup([(r[0], r[1]) for r in rows])
    found = by_id(linededup._with_kept(docs))
    for doc_id, text, *_ in rows:
        assert (found[doc_id]["__kept"] or "") == ("\n".join(want[doc_id]) if text else text or "")
    out = by_id(linededup.dedup_lines(docs))
    gone = {i for i, t, *_ in rows if words(t) and not words("\n".join(want[i]))}
    assert set(out) == set(range(len(rows))) - gone
    assert linededup.dedup_lines(none).count() == 0


def test_partners_share_a_half_and_most_lines_have_two(spark):
    from ruleloom.llm.linededup import _half_keys

    def keys(lines):
        rows = spark.createDataFrame([(line,) for line in lines], "words array<string>").select(_half_keys(F.col("words")).alias("keys"))
        return [r["keys"] and {*r["keys"]} for r in rows.coalesce(1).collect()]

    lines, pairs = [], []
    for n in range(8, 30):
        lines.append([f"w{i}" for i in range(n)])
        whole = len(lines) - 1
        for at in range(n + 1):
            lines.append([*lines[whole][:at], "other", *lines[whole][at:]])
            pairs.append((whole, len(lines) - 1))
            if at < n:
                lines.append([*lines[whole][:at], "other", *lines[whole][at + 1 :]])
                pairs.append((whole, len(lines) - 1))
    found = keys(lines)
    assert all(found[a] & found[b] for a, b in pairs)
    assert [x and len(x) for x in keys([[f"w{i}" for i in range(n)] for n in range(7, 14)])] == [None, 2, 2, 2, 2, 4, 2]


def test_kept_lines_come_from_one_cut_of_the_text(spark):
    from ruleloom.llm.linededup import _with_kept, dedup_lines

    text = "\n".join(f"line {i} of this text" if i % 2 else "this line stands here again" for i in range(3000))
    docs = spark.createDataFrame([(1, text), (2, text + "\nand another"), (3, None)], "doc_id int, text string")
    for found in (_with_kept(docs), dedup_lines(docs)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "lambdafunction(" in plan and "lambdafunction(split(" not in plan
    kept = {r.doc_id: r["text"] for r in dedup_lines(docs).collect()}
    assert kept == {1: "\n".join(["this line stands here again", *(f"line {i} of this text" for i in range(1, 3000, 2))]), 2: "and another", 3: None}


def test_line_dedup_random_edits(spark):
    rng = random.Random(5)
    base = [[rng.choice(VOCABULARY) for _ in range(rng.randint(7, 11))] for _ in range(12)]
    docs = []
    for i in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            if kind == 0:
                w[at] = rng.choice(VOCABULARY)
            elif kind == 1:
                del w[at]
            else:
                w.insert(at, rng.choice(VOCABULARY))
        docs.append((i, " ".join(w)))
    found = by_id(linededup._with_kept(spark.createDataFrame(docs, "doc_id long, text string")))
    want = line_dedup(docs)
    assert {i: found[i]["__kept"] for i, _ in docs} == {i: "\n".join(want[i]) for i, _ in docs}


def test_mixing(docs, rows, none):
    found = mixing.copies(docs).collect()
    again = {r.doc_id: r.copies for r in mixing.copies(docs.repartition(5)).collect()}
    assert len(found) == len(rows) and {r.doc_id: r.copies for r in found} == again
    sizes, taken = {}, {}
    for r in found:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
        assert 0 <= r.copies <= 2
    goal = targets(sizes)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
    largest = {s: max(r.size for r in found if r.source == s) for s in goal}
    for s, t in goal.items():  # whole copies: half of the largest document at most
        assert abs(taken[s] - t) <= largest[s] / 2, s
    many = mixing.mixed(docs)
    assert many.count() == sum(r.copies for r in found) and set(docs.columns) <= set(many.columns)
    assert mixing.copies(none).count() == 0


def test_mixing_of_equal_rows_from_different_sources(spark):
    rng = random.Random(41)
    text = prose(rng, 50)
    rows = [(1, text, "a", 7), (1, text, "b", 8), (1, text, "a", 9)] + [(i, prose(rng, rng.randint(5, 80)), rng.choice("abb"), i) for i in range(2, 60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")
    got = mixing.mixed(frame).collect()
    sizes, taken = {}, {}
    for _, t, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(t.split())
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
        assert (r.doc_id, r.text, r.source, r.copy) in rows and r.copy_ in (1, 2)
    for source, t in targets(sizes).items():
        assert abs(taken[source] - t) <= 40, source


def test_mixing_rates_are_the_tilts_that_meet_the_targets(spark):
    rng = random.Random(42)
    rows = [(i, "w " * rng.randint(1, 200), rng.choice("abc")) for i in range(200)]
    found = mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in "abc":
        own = [r for r in found if r.source == source]
        low, high = -1.0, 1.0  # the multiplier, by halving
        for _ in range(200):
            lam = (low + high) / 2
            rates = [min(2.0, math.exp(min(50.0, lam * r.size))) for r in own]
            low, high = (lam, high) if sum(x * r.size for x, r in zip(rates, own, strict=True)) < own[0].target else (low, lam)
        assert [r.rate for r in own] == pytest.approx(rates, rel=1e-5)


def test_language_model(docs, rows, none):
    found = by_id(brown.score(docs))
    for (doc_id, *_), want in zip(rows, base_scores([(r[0], r[1]) for r in rows]), strict=True):
        r = found[doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4]
        assert r.base_score == pytest.approx(want[4], rel=1e-9)
        assert r.score < 0
    assert brown.score(none).count() == 0


def test_language_model_scores_by_hand(spark, docs, rows, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from ruleloom.llm.textops import slices

    monkeypatch.setattr(brown, "KNOWN", 60)  # some words are known by their ending only
    train = brown.train
    models = []
    monkeypatch.setattr(brown, "train", lambda t: models.append(train(t)) or models[-1])
    got = by_id(brown.score(docs))
    model = models[0][0]
    end = int(model.classes[brown.END])

    def cls(word):
        h, endings, _ = brown._tokens(next(slices(pa.array([word]))))
        return int(model.classes_of(h, endings)[2][0])

    texts = {r[0]: tokens(r[1]) for r in rows}
    count, pair, size, types = {}, {}, {end: 0}, {end: 0}
    for i, own in texts.items():
        if crc(i) != 1:
            c = [end, *map(cls, own), end]
            for a, b in zip(c, c[1:]):
                pair[a, b] = pair.get((a, b), 0) + 1
            for w in own:
                count[w] = count.get(w, 0) + 1
            size[end] += 1
    types[end] = 1
    ends = size[end]
    for w, n in count.items():
        size[cls(w)] = size.get(cls(w), 0) + n
        types[cls(w)] = types.get(cls(w), 0) + 1
    out = {}
    for (a, _), n in pair.items():
        out[a] = out.get(a, 0) + n
    for i, own in texts.items():
        c, total = [end, *map(cls, own), end], 0.0
        for a, b in zip(c, c[1:]):
            total += math.log10((pair.get((a, b), 0) + 0.5) / (out.get(a, 0) + 0.5 * brown.CLASSES))
        for w in own:
            total += math.log10((count.get(w, 0) + 0.5) / (size.get(cls(w), 0) + 0.5 * (types.get(cls(w), 0) + 1)))
        total += math.log10((ends + 0.5) / (size[end] + 0.5 * (types[end] + 1)))
        assert got[i].score == pytest.approx(total, rel=1e-9), i
    assert len(np.unique(model.own)) > 1


def test_gain_of_a_class_against_the_likelihood():
    import numpy as np

    rng = np.random.default_rng(3)
    words = rng.integers(0, 6, 400)
    of = np.array([0, 1, 2, 0, 1, 2])
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()

    def likelihood(of):
        t = np.zeros((brown.CLASSES, brown.CLASSES))
        np.add.at(t, (of[words[:-1]], of[words[1:]]), 1)
        return f(t) - f(t.sum(0)) - f(t.sum(1)), t

    now, table = likelihood(of)
    for w in (5,):
        at = np.flatnonzero(words == w)
        at = at[(at > 0) & (at < len(words) - 1)]
        sides = np.concatenate([of[words[at - 1]], brown.CLASSES + of[words[at + 1]]])
        got = brown.gains(table, sides, np.ones(len(sides), np.int64), np.zeros(len(sides), np.int64), 1, of[[w]])[0]
        want = [likelihood(np.append(of[:5], b))[0] for b in range(3)]
        assert np.argmax(got[:3]) == np.argmax(want)


def test_classes_beat_single_words_where_order_matters(spark):
    rng = random.Random(1)
    kinds = [[f"{k}{i}" for i in range(30)] for k in "abc"]
    docs = [(i, " ".join(rng.choice(kinds[j % 3]) for j in range(60))) for i in range(300)]
    found = brown.score(spark.createDataFrame(docs, "doc_id long, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > 0.9 * found[1]


def test_search(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    vectors[41] = (41, vectors[40][1])
    bad = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [None] + [1.0] * 7), (1080, [float("inf")] * 8), (1100, []), (1120, [1.0] * 3)]
    frame = spark.createDataFrame([*vectors, *bad], "vec_id long, embedding array<double>")
    found = {}
    for r in multiindex.search(multiindex.usable(frame), lambda i: i % 20 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = nearest(vectors)
    assert set(found) == set(want)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    exact = dict(vectors)
    for q, near in found.items():
        assert [s for _, s in near] == sorted((s for _, s in near), reverse=True)
        assert all(s == pytest.approx(sum(a * b for a, b in zip(exact[q], exact[i], strict=True))) for i, s in near)
    assert multiindex.search(multiindex.usable(frame.limit(0)), lambda i: i % 20 == 0).count() == 0


def test_search_visits_a_part_of_many_vectors(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(9)
    n, dim = 24_000, 16
    centres = rng.normal(size=(60, dim))
    x = centres[rng.integers(0, 60, n)] + 0.35 * rng.normal(size=(n, dim))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    seen = []
    enough = multiindex._enough
    monkeypatch.setattr(multiindex, "_enough", lambda *a: seen.append(enough(*a)) or seen[-1])
    found = multiindex.search(multiindex.usable(frame), lambda i: i % 200 == 0).toPandas()
    hits = 0
    for q, own in found.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(own["vec_id"]) & set(np.argsort(-score)[:20].tolist()))
    assert seen[0] < n / 2  # vectors that a walk has to pass
    assert hits >= 0.9 * 20 * (n // 200)


def test_toxicity(spark, none):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(1200):
        toxic = i % 6 == 0
        w = prose(rng, 40).split()
        if toxic:
            for at in rng.sample(range(len(w)), 4):
                w[at] = rng.choice(["grubbit", "snarfer", "idiot", "yelchwad"])
        docs.append((i, " ".join(w).translate(LOWER) if i % 50 else None if not toxic else " ".join(w)))
        labels.append((i, 1, int(toxic) if i % 97 else None))
    documents, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.scores(documents, known).collect()}
    held = [i for i, t in docs if crc(i) == 0 and t]
    assert sum((scores[i] >= 0.5) == (i % 6 == 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in scores.values()) and len(scores) == len(docs)
    kept = {r.doc_id for r in toxicity.drop_toxic(documents, known).collect()}
    assert kept == {i for i, s in scores.items() if s < 0.5}
    assert toxicity.scores(none, known).count() == 0
    assert toxicity.scores(documents, known.limit(0)).count() == len(docs)


def test_label_model_weighs_down_copies_of_a_voter():
    import numpy as np

    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.3).astype(float)
    votes = np.stack([(rng.random(4000) < np.where(y == 1, 0.6, 0.05)) for _ in range(3)], 1).astype(float)
    votes = np.concatenate([votes, votes[:, :1], votes[:, :1]], 1)
    posterior, model = toxicity.label_model(votes, y, np.ones(4000))
    assert model["independence"][0] < 0.5 < model["independence"][1]
    assert ((posterior > 0.5) == (y == 1)).mean() > 0.95


def test_label_model_corrects_noisy_labels():
    import numpy as np

    rng = np.random.default_rng(1)
    y = (rng.random(6000) < 0.3).astype(float)
    votes = np.stack([(rng.random(6000) < np.where(y == 1, 0.6, 0.05)) for _ in range(6)], 1).astype(float)
    given = np.where(rng.random(6000) < 0.2, 1 - y, y)
    posterior, model = toxicity.label_model(votes, given, np.ones(6000))
    assert ((posterior > 0.5) == (y == 1)).mean() > 0.93 > 0.85 > (given == y).mean()
    assert np.abs(model["fires_toxic"] - 0.6).max() < 0.08 and np.abs(model["fires_clean"] - 0.05).max() < 0.05


def test_toxicity_of_repeated_rows(spark):
    rows = [(1, "you idiot")] * 3 + [(2, "a fine day")] * 2 + [(None, None)]
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    few, sizes = toxicity.sample(documents, labels)
    assert few.count() <= 2 and sum(sizes.values()) <= 2
    assert toxicity.scores(documents.withColumn("toxic", F.lit(5)), labels).count() == 6
