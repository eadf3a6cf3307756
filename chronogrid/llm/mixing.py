"""Mixing sources to target weights by entropy balancing.

Each source gets a token target; document rates r are the closest to 1, in
token-weighted relative entropy, that meet all targets:

    minimise  sum_d size_d (r_d log r_d - r_d + 1)
    subject to  sum_{d in s} size_d r_d = target_s  for every source s.

The dual is convex, sum_d size_d exp(l_{s(d)}) - sum_s l_s target_s, and its
solution gives the exponentially tilted rates r_d = exp(l_{s(d)}).  Each Newton
step tilts all documents by the multipliers so far and sums gradient and Hessian
over them, next to each source; as every constraint is on the tokens of one
source, the Hessian is diagonal.  Documents of one source and size are tilted
alike, so that they take the sums as one row with their number.  Steps go on
until every constraint holds to ``EXACT``.

Rates become whole copies: floor(r), and one more for some documents.  Which,
is decided per document size from large to small with the error carried over,
so that a source misses its target by about half of its smallest document.
Long lists of sizes are decided in blocks; the blocks' errors go to the block of
the smallest sizes.  Documents of one size are ordered by a hash of doc_id, in
salted groups.

Everything is DataFrame expressions; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, discard, need_columns, plain_blanks

#: A source's target, and a document's copies, stop at this many times its size.
CAP = 3
#: Relative error of a constraint at which the steps end; steps that always suffice.
EXACT, MOST_STEPS = 1e-12, 800
#: Parts of a group of equally long documents of a source; sizes decided together.
SALTS, BLOCK = 512, 256


def _size(text: str) -> Column:
    words = F.array_remove(F.split(F.replace(plain_blanks(text), F.lit("\n"), F.lit(" ")), " "), "")
    return F.when(F.col(text).isNull(), 0).otherwise(F.size(words)).cast("long")


def _source(source: str) -> Column:
    """A key for a source; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def source_targets(levels: DataFrame) -> DataFrame:
    """__s, source_size, weight, target: one row for each source.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating.  The sum
    of all sizes is shared by weight; a target stops at CAP times its source's
    size, and the excess is reshared among the others.  With the sources in
    order of CAP * size / weight, those that stop are a prefix of them.  The
    table has one row for each source, not for each document.
    """
    one = Window.orderBy(F.col("__s") == "n", "__s")
    sources = (
        levels.groupBy("__s")
        .agg(F.sum(F.col("__size") * F.col("n")).alias("source_size"))
        .withColumn("weight", (F.pmod(F.row_number().over(one) - 1, F.lit(3)) + 1).cast("double"))
        .withColumn("stop", (F.col("source_size") * CAP).cast("double"))
    )
    order = Window.orderBy(F.col("stop") / F.col("weight"), "__s")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    filled = sources.withColumns(
        {
            "rest": F.sum("source_size").over(whole) - F.coalesce(F.sum("stop").over(before), F.lit(0.0)),
            "shares": F.sum("weight").over(after),
        }
    ).withColumn("here", F.col("rest") * F.col("weight") / F.col("shares") <= F.col("stop"))
    first = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pick = lambda c: F.first(F.when(F.col("here"), F.col(c)), ignorenulls=True).over(first)
    return filled.withColumns({"rest": pick("rest"), "shares": pick("shares")}).select(
        "__s", "source_size", "weight", F.least("stop", F.coalesce(F.col("rest") * F.col("weight") / F.col("shares"), F.col("stop"))).alias("target")
    )


def balance(levels: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with rate: exp of the dual solution, by Newton steps from 0.

    ``levels`` holds __s, __size, n: how many documents of a source have a size.
    """
    live = (F.col("source_size") > 0) & (F.col("target") > 0)
    now = cut(targets.where(live).select("__s", "target", F.lit(0.0).alias("l")), "mix-dual")
    for _ in range(MOST_STEPS):
        tilted = levels.join(now, "__s").select("__s", (F.col("__size") * F.col("n") * F.exp("l")).alias("mass"))
        sums = tilted.groupBy("__s").agg(F.sum("mass").alias("hessian"))
        step = now.join(sums, "__s").withColumn("gradient", F.col("hessian") - F.col("target"))
        new = cut(step.select("__s", "target", (F.col("l") - F.col("gradient") / F.col("hessian")).alias("l"), (F.abs("gradient") / F.col("target")).alias("off")), "mix-dual")
        off = new.agg(F.max("off")).first()[0]
        discard(now)
        now = new
        if off is None or off <= EXACT:
            break
    else:
        raise ArithmeticError("the dual steps did not settle")
    rate = F.exp("l")
    whole = F.round(rate)
    rate = F.least(F.when(F.abs(rate - whole) < 1e-9, whole).otherwise(rate), F.lit(float(CAP)))
    return targets.join(now.select("__s", "l"), "__s", "left").withColumn("rate", F.coalesce(rate, F.lit(0.0))).drop("l")


def _fold(start: str) -> str:
    """SQL: of the sizes ls, from large to small, how many documents get one more,
    and the error that is left, from the error ``start``."""
    k = "if(x.v = 0, 0L, greatest(0L, least(x.n, cast(floor((a.e + f * x.v * x.n) / x.v + 0.5) as bigint))))"
    return f"aggregate(ls, named_struct('e', {start}, 'ks', cast(array() as array<bigint>)), (a, x) -> named_struct('e', a.e + f * x.v * x.n - x.v * {k}, 'ks', concat(a.ks, array({k}))))"


def _extra(sized: DataFrame, levels: DataFrame, rates: DataFrame) -> DataFrame:
    """__s, __size, salt, base, k: of the documents there, k get base + 1 copies."""
    salt = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(SALTS)).cast("int").alias("salt")
    parts = sized.groupBy("__s", "__size", salt).count()
    rank = F.row_number().over(Window.partitionBy("__s").orderBy("__size"))
    blocks = levels.withColumn("block", F.floor((rank - 1) / BLOCK)).groupBy("__s", "block")
    arrays = blocks.agg(F.sort_array(F.collect_list(F.struct(F.col("__size").alias("v"), "n")), asc=False).alias("ls"))  # BLOCK elements at most
    arrays = arrays.join(rates.select("__s", F.floor("rate").alias("base"), (F.col("rate") - F.floor("rate")).alias("f")), "__s")
    large = arrays.where("block > 0").withColumn("r", F.expr(_fold("0D")))
    carried = large.groupBy("__s").agg(F.sum("r.e").alias("e"))
    small = arrays.where("block = 0").join(carried, "__s", "left").withColumn("r", F.expr(_fold("coalesce(e, 0D)")))
    chosen = (
        large.select("__s", "base", "ls", "r").union(small.select("__s", "base", "ls", "r"))
        .select("__s", "base", F.explode(F.arrays_zip("ls", F.col("r.ks").alias("ks"))).alias("z"))
        .select("__s", "base", F.col("z.ls.v").alias("__size"), F.col("z.ls.n").alias("n"), F.col("z.ks").alias("k"))
    )
    upto = Window.partitionBy("__s", "__size").orderBy("salt")
    share = lambda c: F.floor(F.col("k") * c / F.col("n"))
    return (
        parts.join(chosen, ["__s", "__size"])
        .withColumn("c", F.sum("count").over(upto))
        .select("__s", "__size", "salt", "base", (share(F.col("c")) - share(F.col("c") - F.col("count"))).alias("k"))
    )


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The decisions and the source table.

    Decisions: doc_id, __s, __size, copies for each row of ``docs``; rows that
    repeat doc_id, source and size get the same copies.  A null text has size
    0; documents of size 0 get the whole copies of their source's rate.  A null
    source is a source of its own, and a null doc_id a doc_id.  An empty table
    gives two empty tables; texts of any length count whole.
    """
    need_columns(docs, "doc_id", "text", "source")
    sized = cut(docs.select("doc_id", _source("source").alias("__s"), _size("text").alias("__size")), "mix-sized")
    levels = cut(sized.groupBy("__s", "__size").agg(F.count(F.lit(1)).alias("n")), "mix-levels")
    targets = cut(source_targets(levels), "mix-targets")
    sources = cut(balance(levels, targets), "mix-sources")
    extra = _extra(sized, levels, sources)
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(SALTS)).cast("int"))
    at = Window.partitionBy("__s", "__size", "salt").orderBy(F.xxhash64("doc_id"), "doc_id")
    decided = (
        salted.withColumn("at", F.rank().over(at))
        .join(extra, ["__s", "__size", "salt"])
        .select("doc_id", "__s", "__size", (F.col("base") + F.when(F.col("at") <= F.col("k"), 1).otherwise(0)).alias("copies"))
    )
    return decided, sources


def mix_sources(docs: DataFrame) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it (perhaps
    never); columns of any name stay as they are."""
    decided, _ = mix(docs)
    times = decided.dropDuplicates(["doc_id", "__s", "__size"]).where("copies > 0")
    times = times.select(F.col("doc_id").alias("__id"), F.col("__s").alias("__t"), F.col("__size").alias("__n"), F.col("copies").alias("__copies"))
    rows = docs.select(F.struct("*").alias("r"))
    on = F.col("r.doc_id").eqNullSafe(F.col("__id")) & (_source("r.source") == F.col("__t")) & (_size("r.text") == F.col("__n"))
    again = rows.join(times.hint("shuffle_hash"), on).select("r", F.explode(F.sequence(F.lit(1).cast("long"), "__copies")))
    return again.select(*[F.col("r").getField(c).alias(c) for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: doc_id, size, source_size, target, taken, copies."""
    decided, sources = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return decided.join(sources, "__s").select(
        "doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.col("copies")).alias("taken"), "copies"
    )
