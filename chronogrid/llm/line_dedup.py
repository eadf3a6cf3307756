"""Line dedup: an exact set-similarity self-join over the lines of all documents.

A line is the set of its distinct lower-cased words.  Lines have the order
(doc_id, line number); a line goes if an earlier line has a word set with
Jaccard similarity of at least ``percent`` / 100.  The result does not depend
on partitions or on the order of rows.

1. Lines with equal sets form a class, found by a partial aggregation; its first
   line stands for it, and all its other lines go.
2. Words are ordered from rare to frequent, so that two similar lines share one
   of their first ``n - ceil(t n) + 1`` words (prefix filter).  Each class makes
   one posting for each of these words.
3. Classes that share such a word are compared by size (length filter), by the
   words left after the shared one (positional filter), and by parity bitmaps
   whose Hamming distance never exceeds the symmetric difference.  A semi-join
   finds the classes that have any candidate; only these go on.
4. A class needs one earlier partner, not all: the nearest by bitmap among the
   first of a group is verified first, then the TRIED nearest of the whole group;
   classes with still more partners are verified with all of them.  So a family of
   n similar lines does not make n**2 rows, and no partner is left out.
   Candidates are verified on their words.

A word's frequency is that of its hash bucket, counted over the lines of all
documents, in a fixed number of buckets; any fixed order of words gives exact results, so that a
shared bucket costs only speed.  Classes are told apart by 128 bits of hashes
and their size; similar lines are verified on the words themselves.

Skew: a class counts once, however many lines it has.  The postings of a word
that is frequent in the corpus are dealt over several tasks; each of them gets
all postings of the word to compare its share with.

Everything is DataFrame expressions; no Python runs on executors.
"""

from __future__ import annotations

import contextlib
import json
import math
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, discard, need_columns, plain_blanks, with_ids

#: Similarity, in percent, from which a later line goes.
PERCENT = 80
#: Hash buckets of the word-frequency table: its size never grows.
BUCKETS = 1 << 17
#: Postings of a word that one task compares; those of a task, at most about.
HOT, PER_TASK = 1 << 16, 1 << 18
#: Lines of a group that every other line of it is compared with first.
LEADERS = 8
#: Partners of a line, the nearest first, that are verified before it is asked whether it has more.
TRIED = 64
#: Words of a line up to which 64 parities tell unlike lines apart.
FOLD = 80
_FAST_MAP = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"
#: Arrays without nulls are written as plain repeated numbers, without a group for each.
_PLAIN_LISTS = "spark.sql.parquet.writeLegacyFormat"
_NO_ID = (1 << 63) - 1
#: Lines that one mark of a document stands for.
_MARKED = 64


class _Places(NamedTuple):
    """SQL: a line's place as one number in the order of lines, and its parts."""

    place: str
    line_no: str
    doc_id: str


_WIDE = _Places(
    "cast(doc_id as decimal(20,0)) * 4294967296BD + line_no", "cast(pmod(at, 4294967296BD) as int)", "((at - pmod(at, 4294967296BD)) div 4294967296BD)"
)
#: For ids of 32 bits.
_NARROW = _Places("shiftleft(doc_id, 32) | cast(line_no as long)", "cast(at & 4294967295L as int)", "shiftright(at, 32)")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id (null: the largest), text; no null texts."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), "text").where("text is not null")


def _words(line: str) -> Column:
    return F.split(F.lower(line), " ")


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), h: the hashes of the distinct words of all lines
    that have words."""
    lines = docs.select("doc_id", F.posexplode(F.split(plain_blanks("text"), "\n")).alias("line_no", "line")).where("trim(line) <> ''")
    hashes = F.array_remove(F.array_distinct(F.transform(_words("line"), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    return lines.select("doc_id", "line_no", hashes.alias("h"))


def _levels(hashed: DataFrame) -> list[int]:
    """The frequency level (0 to 127) of each bucket of words, by the lines that
    hold them."""
    counts = hashed.select(F.explode("h").alias("h")).select(F.col("h").bitwiseAND(BUCKETS - 1).cast("int").alias("b")).groupBy("b").count()
    levels = [0] * BUCKETS
    with _setting(hashed.sparkSession, _FAST_MAP, str(BUCKETS.bit_length() - 1)):  # all BUCKETS (by default half)
        got = counts.toArrow()  # BUCKETS rows at most
    for b, n in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
        levels[b] = min(127, int(math.log2(n + 1) * 2.5))
    return levels


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting for a while; the session's is as before afterwards."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _array(values: list[int], kind: str) -> Column:
    """An array constant."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _sets(hashed: DataFrame, levels: Column, percent: int) -> DataFrame:
    """doc_id, line_no, and of its word set: n, sig, bits and more, prefix.

    A prefix holds the keys (level, then hash) of the rarest words, as many as
    the filter asks for; none, if only an equal set is similar enough.  Parities
    are of 128 places, bits and more; those of FOLD words at most are folded
    into the 64 of bits.
    """
    low = lambda h: F.shiftleft(F.get(levels, h.bitwiseAND(BUCKETS - 1).cast("int")).cast("long"), 56)
    # never null, so that they are sorted as plain numbers
    keys = F.sort_array(F.transform("h", lambda h: F.coalesce(low(h).bitwiseOR(F.shiftrightunsigned(h, 8)), F.lit(0).cast("long"))))
    need = f"((({percent} * n) + 99) div 100)"
    # n words can match n + 1 words only if 100 n >= percent (n + 1)
    alone = f"(100 * n < {percent} * (n + 1))"
    flip = "a ^ shiftleft(1L, cast(x & 63 as int))"
    return (
        hashed.select("doc_id", "line_no", keys.alias("k"))
        .select("doc_id", "line_no", "k", F.size("k").alias("n"))
        .select(
            "doc_id",
            "line_no",
            "n",
            F.xxhash64("k").alias("sig"),
            F.expr(f"if(n <= {FOLD}, aggregate(k, 0L, (a, x) -> {flip}), aggregate(k, 0L, (a, x) -> if(x & 64 = 0, {flip}, a)))").alias("bits"),
            F.expr(f"if(n <= {FOLD}, 0L, aggregate(k, 0L, (a, x) -> if(x & 64 = 0, a, {flip})))").alias("more"),
            F.expr(f"if({alone}, slice(k, 1, 0), slice(k, 1, cast(n - {need} + 1 as int)))").alias("prefix"),
        )
    )


def _classes(sets: DataFrame, places: _Places) -> DataFrame:
    """sig, n, bits, more, prefix, at: one row for each word set, with its first line."""
    return sets.groupBy("sig", "n", "bits", "more", "prefix").agg(F.min(F.expr(places.place)).alias("at"))


def _far(x: str, y: str) -> str:
    """SQL: places of parities that differ; folded, if one of the two is."""
    bits, more = f"{x}.bits ^ {y}.bits", f"{x}.more ^ {y}.more"
    return f"if(least({x}.n, {y}.n) <= {FOLD}, bit_count({bits} ^ {more}), bit_count({bits}) + bit_count({more}))"


def _near(x: str, y: str, percent: int) -> str:
    """SQL: may the sets x and y, met at one shared word, be similar?  They are
    if they share p / (100 + p) of the sum of their sizes, rounded up."""
    both, whole = f"({x}.n + {y}.n)", 100 + percent
    return (  # what differs is at least _far, so that half of the rest at most is shared
        f"({percent} * {both} <= {whole} * shiftright({both} - {_far(x, y)}, 1) and {percent} * {x}.n <= 100 * {y}.n and {percent} * {y}.n <= 100 * {x}.n"
        f" and {whole} * least({x}.n - {x}.pos, {y}.n - if({y}.pos < 0, -1 - {y}.pos, {y}.pos)) >= {percent} * {both})"
    )


def _hot() -> tuple[list[int], int]:
    """Keys for the postings of a word by its level; the first level with two."""
    parts = [max(1, math.ceil(2 ** (level / 2.5) / HOT)) for level in range(128)]
    return parts, next(level for level, n in enumerate(parts) if n > 1)


def _postings(classes: DataFrame) -> DataFrame:
    """token, at, n, bits, more, pos: one row for each prefix word of a class.

    A word above HOT occurrences has its postings dealt by class to several
    keys, which differ from the word's in their last 16 bits; under the other
    keys of the word each is there to be met only, with the negative position
    -1 - pos.  Two words under one key cost only speed.
    """
    parts, hot = _hot()
    kinds = {c: kind for c, kind in classes.dtypes if c in ("sig", "at", "n", "bits", "more")}
    # never null, which keeps filters for it from going below one of two equal shuffles
    classes = classes.select("prefix", *[F.coalesce(c, F.lit(0).cast(kind)).alias(c) for c, kind in kinds.items()])
    level = F.shiftrightunsigned("token", 56).cast("int")
    facts = ("at", "n", "bits", "more")
    plain = classes.select(*facts, F.posexplode("prefix").alias("pos", "token")).where(level < hot).select(F.coalesce("token", F.lit(0)).alias("token"), *facts, "pos")
    many = classes.where(F.shiftrightunsigned(F.element_at("prefix", -1), 56) >= hot)
    many = many.select("sig", *facts, F.posexplode("prefix").alias("pos", "token")).where(level >= hot).withColumn("parts", F.get(_array(parts, "bigint"), level))
    many = many.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return plain.union(many.select(F.coalesce(F.expr("token & ~65535L | salt & 65535L"), F.lit(0)), *facts, F.expr("if(pmod(sig, parts) = salt, pos, -1 - pos)")))


def _involved(classes: DataFrame, percent: int) -> DataFrame:
    """token, at, n, bits, more, pos: the postings that may be of similar classes,
    by one that another class has of the same word."""
    spark = classes.sparkSession
    total = classes.agg(F.sum(F.expr(f"n - (({percent} * n) + 99) div 100 + 1"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PER_TASK))
    # Both sides need all columns, and a condition with rand() does not slip
    # below the shuffle, so that Spark runs it once.
    dealt = _postings(classes.where("size(prefix) > 0")).repartition(parts, "token")
    own = dealt.where("if(pos >= 0, 0, 2) < 1 + rand()")
    met = own.alias("x").join(dealt.alias("y").hint("merge"), F.expr(f"x.token = y.token and {_near('x', 'y', percent)} and x.at <> y.at"), "left_semi")
    whole = F.expr(f"if(shiftrightunsigned(token, 56) >= {_hot()[1]}, token & ~65535L, token)")  # a word has one key again
    return met.select(whole.alias("token"), "at", "n", "bits", "more", "pos")


def _fetch(docs: DataFrame, near: DataFrame, places: _Places, repeated: bool) -> DataFrame:
    """at, w: the distinct words of each class's first line.

    Rows that repeat a doc_id may have other lines at its place; all are given.
    """
    near = near.groupBy(F.expr(places.doc_id).alias("id")).agg(F.collect_set(F.expr(places.line_no)).alias("places"))
    here = with_ids(docs, near.select(F.col("id").alias("doc_id"))).join(near.hint("shuffle_hash"), F.col("doc_id") == F.col("id"))
    lines = here.select("doc_id", "places", F.posexplode(F.split(plain_blanks("text"), "\n")).alias("line_no", "line"))
    chosen = lines.where(F.array_contains("places", F.col("line_no"))).where("trim(line) <> ''")
    words = F.array_remove(F.array_distinct(_words("line")), "")
    out = chosen.select(F.expr(places.place).alias("at"), words.alias("w"))
    return out.distinct() if repeated else out


def _verify(words: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """x of the pairs (x, y) of places whose whole word sets are similar enough."""
    a, b = words.select(F.col("at").alias("x"), F.col("w").alias("a")), words.select(F.col("at").alias("y"), F.col("w").alias("b"))
    both = pairs.select("x", "y").join(b, "y").join(a, "x").withColumn("i", F.size(F.array_intersect("a", "b")))
    return both.where(f"100 * i >= {percent} * (size(a) + size(b) - i)").select("x").distinct()


def _redundant(docs: DataFrame, classes: DataFrame, percent: int, places: _Places, repeated: bool) -> DataFrame:
    """x: the places of classes' first lines to which an earlier line is similar."""
    group = cut(_involved(classes, percent), "lines-near")
    words = cut(_fetch(docs, group.select("at").distinct(), places, repeated), "lines-words")
    order = Window.partitionBy("token").orderBy("at")
    first = group.withColumn("rank", F.row_number().over(order)).where(f"rank <= {LEADERS}").drop("rank")
    meet = lambda x, y: x.alias("x").join(y.alias("y"), F.expr(f"x.token = y.token and y.at < x.at and {_near('x', 'y', percent)}")).select(
        F.col("x.at").alias("x"), F.col("y.at").alias("y"), F.expr(_far("x", "y")).alias("far")
    )
    similar = lambda pairs: cut(_verify(words, pairs, percent), "lines-similar")
    without = lambda x, found: x.join(found, F.col("at") == F.col("x"), "left_anti")
    found = similar(meet(group, first).groupBy("x").agg(F.min_by("y", "far").alias("y")))
    # a partner met at several words has one rank
    rank = F.dense_rank().over(Window.partitionBy("x").orderBy("far", "y"))
    tried = meet(without(group, found), group).withColumn("rank", rank).where(f"rank <= {TRIED + 1}")
    tried = cut(tried.select("x", "y", "rank").distinct(), "lines-tried")
    more = similar(tried.where(f"rank <= {TRIED}"))
    found = found.union(more)
    many = tried.where(f"rank > {TRIED}").select("x").join(more, "x", "left_anti")
    if not many.isEmpty():
        rest = group.join(many, F.col("at") == F.col("x"), "left_semi")
        found = found.union(similar(meet(rest, group).select("x", "y").distinct()))
    out = cut(found, "lines-redundant")
    discard(group, words, tried)
    return out


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, line_no of every line that an earlier similar line makes redundant."""
    need_columns(docs, "doc_id", "text")
    marks = _marks(docs, percent).select(F.col("__id").alias("doc_id"), F.explode("__keep").alias("part", "bits"))
    lines = _keyed(docs).select("doc_id", F.posexplode(F.split(plain_blanks("text"), "\n")).alias("line_no", "line")).where("trim(line) <> ''")
    kept = marks.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(_MARKED - 1))).alias("i"), "part", "bits")
    kept = kept.where("bits & shiftleft(1L, i) <> 0").select("doc_id", F.expr(f"part * {_MARKED} + i").alias("line_no"))
    return lines.select("doc_id", "line_no").distinct().join(kept, ["doc_id", "line_no"], "left_anti")


def _marks(docs: DataFrame, percent: int) -> DataFrame:
    """__id, __keep: of each doc_id, by line number div 64, the lines with words
    that stay, as bits."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"))
    low, high = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
    places = _NARROW if low is None or -(1 << 31) <= low and high < 1 << 31 else _WIDE
    docs = _keyed(docs)
    with _setting(docs.sparkSession, _PLAIN_LISTS, "true"):
        hashed = cut(_hashed(docs), "lines-hashes")  # split and hashed once, read twice
    sets = _sets(hashed, _array(_levels(hashed), "int"), percent)
    classes = cut(_classes(sets, places), "lines-classes")
    twice = ids.groupBy("doc_id").count().where("count > 1").select("doc_id")
    mine = None
    if not twice.isEmpty():  # a place that goes, goes from all rows of its doc_id
        mine = cut(sets.join(twice, "doc_id", "left_semi").select("sig", F.expr(places.place).alias("at")).distinct(), "lines-repeated")
    discard(hashed)
    gone = _redundant(docs, classes, percent, places, mine is not None).select(F.col("x").alias("at"))
    if mine is not None:
        gone = gone.union(mine.join(classes, ["sig", "at"], "left_anti").select("at"))
    marks = classes.select("at", F.lit(True).alias("stays")).union(gone.select("at", F.lit(False)))
    bit = f"shiftleft(1L, line_no % {_MARKED})"
    marks = marks.select(F.expr(places.doc_id).cast("long").alias("__id"), F.expr(places.line_no).alias("line_no"), "stays").repartition("__id")
    bits = F.expr(f"bit_or(if(stays, {bit}, 0L)) & ~bit_or(if(stays, 0L, {bit}))")
    lists = marks.groupBy("__id", F.expr(f"line_no div {_MARKED}").cast("int").alias("part")).agg(bits.alias("bits")).where("bits <> 0")
    return lists.groupBy("__id").agg(F.map_from_entries(F.collect_list(F.struct("part", "bits"))).alias("__keep"))


def _stripped(docs: DataFrame, percent: int) -> DataFrame:
    """r (the whole row), text (what stays), n_lines, n_removed."""
    need_columns(docs, "doc_id", "text")
    marks = _marks(docs, percent)
    rows = docs.select(F.struct("*").alias("r"))
    key = F.coalesce(F.col("r.doc_id").cast("long"), F.lit(_NO_ID))
    joined = rows.join(marks.hint("shuffle_hash"), key == F.col("__id"), "left")
    lines = joined.select("r", "__keep", F.split(F.col("r.text"), "\n").alias("ls"))
    # maps are merged by hashed keys, so that long documents take linear time
    parts = f"sequence(0, (size(ls) - 1) div {_MARKED})"
    bits = f"map_values(map_zip_with(map_from_arrays({parts}, {parts}), __keep, (i, p, b) -> coalesce(b, 0L)))"
    stays = f"get(b, cast(i div {_MARKED} as int)) & shiftleft(1L, i % {_MARKED}) <> 0 or not rlike(l, '[^\\\\x20\\\\x09-\\\\x0D]')"
    # bits as a lambda's argument, made once for a document and not for a line
    kept = F.expr(f"get(transform(array(if(__keep is null or ls is null, array(0L), {bits})), b -> filter(ls, (l, i) -> {stays})), 0)")
    return lines.select("r", "ls", F.when(F.col("ls").isNotNull(), kept).alias("kept")).select(
        "r",
        F.array_join("kept", "\n").alias("text"),
        F.when(F.col("ls").isNull(), 0).otherwise(F.size("ls")).cast("long").alias("n_lines"),
        F.when(F.col("ls").isNull(), 0).otherwise(F.size("ls") - F.size("kept")).cast("long").alias("n_removed"),
    )


def _columns(docs: DataFrame, *but: str) -> list[Column]:
    return [F.col("text") if c == "text" else F.col("r").getField(c).alias(c) for c in docs.columns if c not in but]


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the redundant lines taken out of ``text``, and n_lines and
    n_removed added; columns of these two names are replaced, all others, of any
    name, stay as they are.

    Lines are what line feeds part; a line without a word always stays.  A null
    text stays null and has no lines; an empty text has one, without words.  A
    document that loses all its lines stays, with an empty text.  A null doc_id
    comes last in the order.  Rows that repeat a doc_id share its line numbers:
    lines at the same place of the same doc_id are not each other's earlier
    line, and a place that goes goes from all of them.  An empty table gives an
    empty table; a text of any length is one document.
    """
    return _stripped(docs, percent).select(*_columns(docs, "n_lines", "n_removed"), "n_lines", "n_removed")


def drop_redundant(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs``, with its columns only, without redundant lines and without the
    documents of which no line with a word is left; what had no word stays."""
    had = F.col("n_removed") > 0
    left = F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return _stripped(docs, percent).where(F.coalesce(~had | left, F.lit(True))).select(*_columns(docs))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup over all documents: doc_id, n_lines, n_removed, and the
    SHA-256 of the text that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("text_sha256"))


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)
), sets AS (
  SELECT doc_id, line_no, list_sort(list_distinct(regexp_extract_all(lower(line), '[^\\x20\\x09-\\x0D]+'))) AS w FROM lines
), classes AS (
  SELECT w, len(w) AS n, min((doc_id, line_no)) AS first FROM sets WHERE len(w) > 0 GROUP BY w
), words AS (
  SELECT first, n, unnest(w) AS word FROM classes
), ranked AS (
  SELECT first, n, word, row_number() OVER (PARTITION BY first ORDER BY df, word) AS pos
  FROM words JOIN (SELECT word, count(*) AS df FROM words GROUP BY word) USING (word)
), prefix AS (
  SELECT first, n, word FROM ranked WHERE pos <= n - (({PERCENT} * n + 99) // 100) + 1
), pairs AS (
  SELECT DISTINCT x.first AS x, y.first AS y FROM prefix x JOIN prefix y USING (word)
  WHERE y.first < x.first AND {PERCENT} * x.n <= 100 * y.n AND {PERCENT} * y.n <= 100 * x.n
), near AS (
  SELECT DISTINCT x FROM (
    SELECT x, a.n AS n, b.n AS m, len(list_intersect(a.w, b.w)) AS i
    FROM pairs JOIN classes a ON a.first = x JOIN classes b ON b.first = y)
  WHERE 100 * i >= {PERCENT} * (n + m - i)
), gone AS (
  SELECT doc_id, line_no FROM sets JOIN classes USING (w)
  WHERE (doc_id, line_no) <> first OR first IN (SELECT x FROM near)
), kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY line_no) AS t, count(*) AS k
  FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
  CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END - coalesce(k, 0) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(t, '')) END AS text_sha256
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
