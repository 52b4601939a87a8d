"""Line deduplication with a deletion neighbourhood, in DataFrame operations only.

A line's words (lower-cased ``alnum`` words) are its key. A line goes if an earlier line has the same
words, or, for lines of ``FUZZY_WORDS`` words or more, words at edit distance 1 (one word inserted,
deleted or replaced). Earlier means: smaller document id (null last), then text hash, then line number.
Whether that earlier line itself goes doesn't matter, so the outcome doesn't depend on an order of work.

The neighbourhood: a line emits itself and every variant with one word deleted, as 64-bit hashes. Lines at
distance 1 share one: both with the same position deleted (a replaced word), or one line whole (an
inserted word). Keyed by hash and position, all members of a group are within the bound of each other, so
the earliest of each group is found by aggregation and no pairs within a group are made. The partner that
is found is verified on the words themselves. Variants are hashed in linear time: a variant is the xor of
its words hashed with their positions, from running xors over the line.

Only lines that can have a partner emit variants: an edit leaves the first or the second half of the
shorter line alone, so a line neither of whose halves begins or ends another line has no partner. Lines that emit
variants are numbered in the order of their places (range partitions, sorted), so that a variant is three
numbers and the earliest of a group is a plain minimum.

Edge cases: null and empty texts have no lines; lines without words always stay; rows equal in id and
text are one document and get the same result; an empty table gives an empty result; columns other than
``doc_id`` and ``text`` are carried along by ``dedup_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.llm.common import LOWER, UPPER, discard, written

FUZZY_WORDS, ROW_WORDS = 8, 64
#: Runs of what is no word of a lower-cased line; single characters, as a regular expression tests these by one look-up.
NOT_WORD_IN_LINE = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
WORD_IN_TEXT = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Characters beyond ASCII that Unicode lower-casing may change.
OTHER_CASE = r"[^\x00-\x7F\p{Ll}\p{Lo}\p{P}]"


def _text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _line_words(line: Column) -> Column:
    """The words of a line, A-Z in lower case."""
    ascii_only = F.octet_length(line) == F.length(line)  # tells most lines far sooner than the expression
    low = F.when(ascii_only | ~F.rlike(line, F.lit(OTHER_CASE)), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))
    return F.array_remove(F.split(low, NOT_WORD_IN_LINE), "")


def _lines(documents: DataFrame) -> DataFrame:
    """``doc_id, text_hash, line_no, words`` of the lines that have words."""
    own = documents.select("doc_id", _hash(_text()).alias("text_hash"), _text().alias("text"))
    cut = own.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    # Not a filter on the words: Spark would cut every line twice.
    return cut.where(F.rlike("line", F.lit(WORD_IN_TEXT))).select("doc_id", "text_hash", "line_no", _line_words(F.col("line")).alias("words"))


def _half_keys(words: Column) -> Column:
    """Hashes of a line's first and last words, of which a partner shares one or the other.

    An edit leaves the first or the last half of the shorter line alone. The halves of lines of 4k to 4k + 3 words
    are cut down to 2k words, so that partners of nearly all lengths look at equally many and most lines have two keys;
    only a line of 4k words may have a partner of the length class below, and has that one's keys too.
    """
    n = F.size(words)

    def keys(p):
        return [F.xxhash64(F.lit(0), F.slice(words, F.lit(1), p)), F.xxhash64(F.lit(1), F.slice(words, n - p + 1, p))]

    own = (F.floor(n / 4) * 2).cast("int")
    both = F.array(*keys(own), *keys(own - 2))
    return F.when(n >= FUZZY_WORDS, F.when((n % 4 == 0) & (n > FUZZY_WORDS), both).otherwise(F.array(*keys(own))))


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "line_no")


def _variants(lines: DataFrame) -> DataFrame:
    """``variant, at, line``: the whole line (``at`` -1) and each deletion of one word, of ``lines (line, words)``.

    With k[i] the hash of word i at its place and m[i] its hash one place earlier, the variant without word i is
    all m, xor k[i], xor the running xor of k and m up to i. Lines of up to ``ROW_WORDS`` words do this within
    their row, longer ones with their words as rows, so that no line costs the square of its length.
    """
    few = lines.where(F.size("words") <= ROW_WORDS)
    zero = F.lit(0).cast("bigint")
    kept, moved = F.transform("words", lambda w, i: F.xxhash64(w, i)), F.transform("words", lambda w, i: F.xxhash64(w, i - 1))
    few = few.select("line", F.size("words").alias("n"), kept.alias("kept"), moved.alias("moved"))
    start = F.struct(F.array().cast("array<bigint>").alias("to"), zero.alias("x"))

    def add(a, pair):
        x = a["x"].bitwiseXOR(pair["kept"]).bitwiseXOR(pair["moved"])
        return F.struct(F.array_append(a["to"], x).alias("to"), x.alias("x"))

    xor = lambda c: F.aggregate(c, zero, lambda a, b: a.bitwiseXOR(b))
    few = few.select("line", "n", "kept", F.aggregate(F.arrays_zip("kept", "moved"), start, add)["to"].alias("to"), xor("moved").alias("all"), xor("kept").alias("whole"))
    each = F.zip_with("kept", "to", lambda k, t: F.xxhash64(F.col("all").bitwiseXOR(k).bitwiseXOR(t), F.col("n") - 1))
    few = few.select("line", F.posexplode(F.concat(F.array(F.xxhash64("whole", "n")), each)).alias("at", "variant"))
    few = few.select("variant", (F.col("at") - 1).alias("at"), "line")

    one = lines.where(F.size("words") > ROW_WORDS).select("line", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    running = Window.partitionBy("line").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    line = Window.partitionBy("line")
    x = one.withColumn("kept", F.xxhash64("word", "at")).withColumn("moved", F.xxhash64("word", F.col("at") - 1)).drop("word")
    x = x.withColumn("to", F.bit_xor(F.col("kept").bitwiseXOR(F.col("moved"))).over(running))
    x = x.withColumn("all", F.bit_xor("moved").over(line)).withColumn("whole", F.bit_xor("kept").over(line))
    deleted = x.select(F.xxhash64(F.col("all").bitwiseXOR(F.col("kept")).bitwiseXOR(F.col("to")), F.col("n") - 1).alias("variant"), "at", "line")
    whole = x.where("at = 0").select(F.xxhash64("whole", "n").alias("variant"), F.lit(-1).alias("at"), "line")
    return few.union(deleted).union(whole)


def _within_one(a: Column, b: Column) -> Column:
    """Whether two word arrays are at edit distance 1 at most: what differs lies in one word."""
    equal_to = lambda x, y: F.array_position(F.zip_with(x, y, lambda s, t: s.eqNullSafe(t)), False)
    most = F.greatest(F.size(a), F.size(b))
    head = F.when(equal_to(a, b) == 0, most).otherwise(equal_to(a, b) - 1)
    tail = F.when(equal_to(F.reverse(a), F.reverse(b)) == 0, most).otherwise(equal_to(F.reverse(a), F.reverse(b)) - 1)
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (head + tail >= most - 1)


def _partners(variants: DataFrame) -> DataFrame:
    """``line, earlier``: for each line the earliest one of each group of equal variants that it is in."""
    deleted, whole = variants.where("at >= 0"), variants.where("at < 0").select("variant", F.col("line").alias("whole"))
    # Replaced words: the earliest line of the same variant and position.
    groups = deleted.groupBy("variant", "at").agg(F.min("line").alias("earlier"), F.max("line").alias("last")).where("earlier < last").drop("last")
    replaced = deleted.join(groups, ["variant", "at"]).where("line > earlier").select("line", "earlier")
    # Inserted words: a line and the whole line that its deletion gives, in both directions.
    met = deleted.join(whole, "variant")
    longer = met.where("line > whole").select("line", F.col("whole").alias("earlier"))
    shorter = met.where("line < whole").groupBy(F.col("whole").alias("line")).agg(F.min("line").alias("earlier"))
    return replaced.union(longer).union(shorter).distinct()


def _near(documents: DataFrame, lines: DataFrame, first: DataFrame) -> DataFrame:
    """``key``: lines at distance 1 from an earlier one."""
    halves = lines.where("halves is not null").select("key", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("half")
    able = written(halves.join(shared, "half", "left_semi").select("key").distinct(), "line-able")
    order = [F.col("doc_id").isNull(), "doc_id", "text_hash", "line_no"]
    places = written(first.join(able, "key", "left_semi").select("key", "place.*").drop("none"), "line-places")
    places_in_order = places.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("line", F.monotonically_increasing_id())
    numbered = written(places_in_order, "line-order")

    wanted = numbered.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_list(F.struct("line", "line_no")).alias("wanted"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    cut = documents.select("doc_id", _hash(_text()).alias("text_hash"), _text().alias("text")).join(wanted, same)
    cut = cut.select("wanted", F.split("text", "\n").alias("lines"))
    each = F.transform("wanted", lambda w: F.struct(w["line"].alias("line"), F.get("lines", w["line_no"]).alias("text")))
    cut = cut.select(F.inline(each)).dropDuplicates(["line"])  # rows that are equal in id and text
    texts = written(cut.select("line", _line_words(F.col("text")).alias("words")), "line-texts")

    variants = written(_variants(texts), "line-variants")
    pairs = _partners(variants)
    with_words = pairs.join(texts, "line").join(texts.select(F.col("line").alias("earlier"), F.col("words").alias("other")), "earlier")
    near = with_words.where(_within_one(F.col("words"), F.col("other"))).select("line").distinct()
    out = written(numbered.join(near, "line", "left_semi").select("key"), "line-near")
    discard(able, places, numbered, texts, variants)
    return out


def removed_lines(documents: DataFrame) -> DataFrame:
    """``doc_id, text_hash, line_nos``: the lines that go, for documents where any goes."""
    lines = _lines(documents).select("doc_id", "text_hash", "line_no", F.xxhash64("words").alias("key"), _half_keys(F.col("words")).alias("halves"))
    lines = written(lines, "line-keys")
    first = lines.groupBy("key").agg(F.min(_place()).alias("place"), F.max(_place()).alias("last"))
    first = written(first.select("key", "place", (F.col("place") != F.col("last")).alias("again")), "line-first")
    near = _near(documents, lines, first)
    decided = first.join(near.withColumn("near", F.lit(True)), "key", "left").where("near or again")
    gone = lines.join(decided.select("key", "place", F.coalesce("near", F.lit(False)).alias("near")), "key").where(F.col("near") | (_place() != F.col("place")))
    out = written(gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("line_nos")), "line-gone")
    discard(lines, first, near)
    return out


def _with_kept(documents: DataFrame) -> DataFrame:
    """All documents with their lines, the numbers of the lines that go, and the text that stays."""
    gone = removed_lines(documents).withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash", "line_nos": "__gone"})
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (_hash(_text()) == F.col("__hash"))
    joined = documents.join(gone, same, "left").drop("__id", "__hash")
    lines = F.split(_text(), "\n")

    def left(own):
        stay = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("__gone"))
        return F.array_join(F.transform(stay, lambda i: F.get(own, i)), "\n")

    # The lines are an argument: where they stood in the function of a line, Spark would cut the text for each line anew.
    kept = F.when(F.col("__gone").isNull(), F.col("text").cast("string")).otherwise(F.transform(F.array(lines), left)[0])
    return joined.withColumn("__kept", kept).withColumn("__n", F.when(_text() == "", 0).otherwise(F.size(lines)))


def dedup_lines(documents: DataFrame) -> DataFrame:
    """The documents with the lines that stay as their text.

    A document that loses every line that has words is a copy as a whole and goes. ``n_chars`` follows
    the text where there is such a column.
    """
    columns = documents.columns
    stays = _with_kept(documents).where(F.col("__gone").isNull() | F.rlike("__kept", F.lit(WORD_IN_TEXT)))
    out = stays.drop("text").withColumnRenamed("__kept", "text")
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out.select(*columns)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` over all documents."""
    found = _with_kept(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col("__n").cast("long").alias("n_lines"),
        F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long").alias("n_removed"),
        F.sha2(F.coalesce("__kept", F.lit("")), 256).alias("kept_sha256"),
    )


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, i AS line_no, string_split(coalesce(text, ''), chr(10))[i] AS line,
         list_filter(regexp_split_to_array(translate(string_split(coalesce(text, ''), chr(10))[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(i)
), k AS (
  SELECT *, array_to_string(words, ' ') AS key, len(words) AS n FROM l WHERE len(words) > 0
), f AS (
  SELECT key, any_value(words) AS words, any_value(n) AS n, min((doc_id, line_no)) AS place FROM k GROUP BY key
), v AS (
  SELECT key, place, array_to_string(words[1 : i - 1], ' ') || ' ' || array_to_string(words[i + 1 :], ' ') AS variant, i AS spot FROM f, unnest(range(1, n + 1)) AS u(i) WHERE n >= 8
  UNION ALL
  SELECT key, place, key, 0 FROM f WHERE n >= 8
), c AS (SELECT key, place, trim(variant) AS variant, spot FROM v),
g AS (SELECT variant, spot, min(place) AS place FROM c GROUP BY ALL),
w AS (SELECT variant, place FROM c WHERE spot = 0),
d AS (SELECT variant, min(place) AS place FROM c WHERE spot > 0 GROUP BY ALL),
near AS (
  SELECT c.key FROM c JOIN g ON c.variant = g.variant AND c.spot = g.spot WHERE c.spot > 0 AND c.place > g.place
  UNION SELECT c.key FROM c JOIN w ON c.variant = w.variant WHERE c.spot > 0 AND c.place > w.place
  UNION SELECT c.key FROM c JOIN d ON c.variant = d.variant WHERE c.spot = 0 AND c.place > d.place
), gone AS (
  SELECT k.doc_id, k.line_no FROM k JOIN f ON k.key = f.key WHERE (k.doc_id, k.line_no) <> f.place OR k.key IN (SELECT key FROM near)
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (g.line_no IS NULL) AS text, count(*) AS n_lines, count(g.line_no) AS n_removed
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE n_lines END AS n_lines, n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d JOIN kept ON d.doc_id = kept.doc_id
"""
