"""Operator 8: mixing sources to target weights by weighted fair queueing.

Sources in code-point order (null last) get the given weights in turn and share the budget, which is
the size of all documents; a source's target stops at ``most`` times its size and the excess goes to
the others by weight. Inside a source documents stand in the order of an MD5 of their id and text, once for each
of ``most`` rounds. A copy's virtual finish time is the source's words up to its end divided by the
source's target; copies are taken in the order of that time until the budget is used.

Scale: only id, source, size and hashes move. A source is cut into 4,096 parts by its MD5, so that a hot
source is many groups: parts are summed first, running sums inside a part are added to those of the
parts before. Times are dealt to ranges of equal width, ranges are summed, and the range in which
the budget ends is cut again until it holds at most ``SORTED`` copies, which are sorted; the cut is one row. Single tasks
see one row a source (some millions fit), one a range, and those copies.

Cases: a null or empty text has size 0 and takes no words; null source is a source; a source of size
0 has target 0; null doc_ids are like empty ones in the MD5; rows alike in doc_id, source and text stay rows of their own: ``mixed``
numbers them (by their other columns) and takes each as often as one of their decisions says, so the words taken are
those decided; copies with the same time come by source, round, MD5 and doc_id; an empty table gives no rows; other columns,
whatever their names, are carried by ``mixed`` and else not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

WEIGHTS, MOST, RANGES, SORTED = (1, 2, 3), 3, 4096, 100_000


def size_of(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009..D."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def marked(doc_id: Column, text: Column) -> Column:
    """An MD5 of id and text, which deals documents out and orders them."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")))))


def targets(slim: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, known (false for the null source), source_rank, source_size, target."""
    by = slim.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    by = by.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    by = by.withColumn("share", F.col("left").cast("double") / F.sum("weight").over(after)).withColumn("nth", F.row_number().over(order))
    # The first source, by cap for its weight, that its share doesn't fill: those before it are full, it and the rest share.
    first = F.min(F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.struct("nth", "share"))).over(everything)
    by = by.withColumn("first", first)
    target = F.when(F.col("nth") < F.col("first.nth"), F.col("cap").cast("double")).otherwise(F.col("first.share") * F.col("weight"))
    return by.select("source", "source_rank", "source_size", target.alias("target"))


def decisions(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, md5 (of id and text), size, source_size, target, copies for every row."""
    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), marked(F.col("doc_id"), text).alias("md5"), size_of(text).alias("size"))
    slim = scratch.written(slim.withColumn("part", F.substring("md5", 1, 3)))
    parts = slim.groupBy("source", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    sources = targets(slim, weights, most)
    parts = parts.alias("p").join(sources.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select(F.col("p.source").alias("source_"), F.col("part").alias("part_"), "base", "source_rank", "source_size", "target")
    inside = Window.partitionBy("source", "part").orderBy("md5", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = slim.withColumn("upto", F.sum("size").over(inside)).join(parts, F.col("source").eqNullSafe(F.col("source_")) & (F.col("part") == F.col("part_")))
    placed = scratch.written(placed.select("doc_id", "source", "md5", "size", "source_rank", "source_size", "target", (F.col("base") + F.col("upto")).alias("end")))

    finish = lambda k: (F.col("end") + F.col("source_size") * (k - 1)).cast("double") / F.col("target")
    key = lambda k: F.struct(finish(k).alias("finish"), "source_rank", F.lit(k).alias("round"), "md5", "doc_id")
    live = placed.where("size > 0 and target > 0")
    copies = live.select("size", F.explode(F.array(*(key(k) for k in range(1, most + 1)))).alias("key"))
    budget = placed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first().b
    # The time at which the budget ends: between ``low`` and ``high``, with ``base`` words before.
    low, high, base, cut = 0.0, float(most + 1), 0, None
    while True:
        width = (high - low) / RANGES
        own = copies.where((F.col("key.finish") >= low) & (F.col("key.finish") < high)).withColumn("range", F.floor((F.col("key.finish") - low) / width).cast("long"))
        sums = own.groupBy("range").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("key.finish").alias("least"), F.max("key.finish").alias("most"))
        sums = sums.withColumn("upto", F.sum("words").over(Window.orderBy("range")) + base)
        last = sums.where(F.col("upto") > budget).orderBy("range").first()
        if last is None:  # everything fits
            break
        base = last.upto - last.words
        low, high = last.least, math.nextafter(last.most, math.inf)
        if last.n <= SORTED or last.least == last.most:
            running = F.sum("size").over(Window.orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
            inside = own.where((F.col("key.finish") >= low) & (F.col("key.finish") < high))
            cut = inside.withColumn("upto", running).where(F.col("upto") + base <= budget).agg(F.max("key").alias("key")).first().key
            break
    if last is None:
        taken = F.lit(most)
    elif cut is None:  # nothing of the last range
        taken = sum(((finish(k) < low).cast("int") for k in range(1, most + 1)), F.lit(0))
    else:
        at = F.struct(F.lit(cut.finish).cast("double").alias("finish"), F.lit(cut.source_rank).cast("int").alias("source_rank"), F.lit(cut["round"]).alias("round"), F.lit(cut.md5).alias("md5"), F.lit(cut.doc_id).cast("long").alias("doc_id"))
        taken = sum(((key(k) <= at).cast("int") for k in range(1, most + 1)), F.lit(0))
    copies_taken = F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(0)
    return placed.select("doc_id", "source", "md5", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), copies_taken.cast("int").alias("copies"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken."""
    inner = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = {x: F.col(f"c{docs.columns.index(x)}") for x in ("doc_id", "source", "text")}
    key = lambda md5, source: F.concat(md5, F.coalesce(F.concat(F.lit("+"), source), F.lit("-")))
    chosen = decisions(docs, weights, most).where("copies > 0").groupBy(key(F.col("md5"), F.col("source")).alias("key"))
    # Of rows alike, how many are taken at least once, twice ...
    chosen = chosen.agg(F.array(*(F.sum((F.col("copies") >= k).cast("int")) for k in range(1, most + 1))).alias("often"))
    order = F.xxhash64(*(c for c, kind in inner.dtypes if "map<" not in kind and "variant" not in kind))
    keyed = inner.withColumn("key", key(marked(at["doc_id"], at["text"].cast("string")), at["source"].cast("string")))
    keyed = keyed.withColumn("number", F.row_number().over(Window.partitionBy("key").orderBy(order)))
    copies = F.aggregate("often", F.lit(0), lambda n, x: n + (x >= F.col("number")).cast("int"))
    joined = keyed.join(chosen, "key").withColumn("copies", copies).where("copies > 0")
    return joined.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*inner.columns).toDF(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM d GROUP BY source
), w AS (SELECT *, (rnk - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM s
), x AS (
  SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, rnk) AS nth,
    ((sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
      / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS share FROM w
), f AS (SELECT min(nth) AS k, min_by(share, nth) AS lam FROM x WHERE share * weight <= cap
), t AS (SELECT source, rnk, source_size, CASE WHEN nth < k THEN cap::DOUBLE ELSE lam * weight END AS target FROM x, f
), p AS (
  SELECT d.*, t.rnk, t.source_size, t.target, sum(d.size) OVER (PARTITION BY t.rnk ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto,
    row_number() OVER () AS id FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT p.*, n.k, (upto + source_size * (n.k - 1))::DOUBLE / target AS finish FROM p, (SELECT unnest([1, 2, 3]) AS k) n WHERE size > 0 AND target > 0
), r AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rnk, k, h, doc_id NULLS FIRST) AS used FROM c
), g AS (SELECT id, count(*) AS n FROM r WHERE used <= (SELECT sum(size) FROM d) GROUP BY id)
SELECT doc_id, size, source_size, coalesce(target, 0) AS target, (size * coalesce(n, 0))::BIGINT AS taken FROM p LEFT JOIN g USING (id)
"""
