"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source's target over its words gives the copies that each of its documents should have on average. The
whole part is allocated to every document. The rest is an unequal-probability sample without
replacement: document i with inclusion probability p_i and a uniform number u_i is ranked by the
Pareto quotient (u_i / (1 - u_i)) / (p_i / (1 - p_i)), and the smallest quotients enter until the source's size
is met. The size is fixed in words: the last document enters if that brings the total nearer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import durable
from .text import word_count

WEIGHTS = (5.0, 2.0, 1.0)
CELLS = 4096  # of rank; a window sorts one cell of one source
UNIT = 2.0**48


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1), the same in every run and engine: 48 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(UNIT)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, ...) with one row per source -> with weight and target.

    Targets follow the weights and sum to ``share`` of all words; none is above ``most`` times its source's
    size, and what is cut off goes to the others by weight until none is above. Sources are few;
    their table is put into one window.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    every = Window.partitionBy()
    full = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("weight", pick)
        .withColumn("cap", F.col("source_size") * F.lit(most))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("nth", F.row_number().over(full))
        .withColumn("whole", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("left_over", F.col("whole") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left_over") / F.col("left_weight"))
    )
    # the first source, by cap over weight, that its share does not fill sets the level for all after it
    open_level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("nth", "level"))).over(every)["level"]
    return ranked.withColumn("open_level", open_level).select(
        *sizes.columns,
        "weight",
        F.when(F.col("ratio") > F.col("level"), F.col("open_level") * F.col("weight")).otherwise(F.col("cap")).alias("target"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    keep_row: bool = False,
) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken): one row per input row.

    ``taken`` is copies times size. Within a source, documents up to its mean size are twice as likely to
    get the extra copy, so that few very long ones do not decide the sample. A probability of
    one or more is certain: quotient 0. Null text has size 0 and takes nothing; a null source is a source
    of its own, last in order. Rows that repeat an id share its random number; rows without id draw by their
    text. Ties go by id, then by text, so that reruns and other orders of the input agree; rows that have both
    in common are alike. Source totals are partial sums, and ranks are cut in 4096 cells: a window
    sorts the one cell of a source in which its sample ends, about a 4096th of its rows and what
    shares a random number there.
    ``keep_row`` adds the input row as a struct; it is then read a second time, and not stored between.
    """
    keys = [
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        uniform(F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))), seed).alias("u"),
        F.xxhash64(F.col(text_col).cast("string")).alias("tie"),
    ]
    base = durable(docs.select(*keys))
    sums = durable(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    mean = source_targets(sums, weights, share, most)
    of_source = sums.select(F.col("source").alias("of"), F.col("source_size").alias("all_size"), "n")
    short = (
        base.join(_sent(of_source), F.col("source").eqNullSafe(F.col("of")))
        .where(F.col("size") * F.col("n") <= F.col("all_size"))
        .groupBy(F.col("source").alias("short_source"))
        .agg(F.sum("size").alias("short_size"))
    )
    plan = durable(
        mean.join(short, F.col("source").eqNullSafe(F.col("short_source")), "left")
        .withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("whole", F.floor("ratio"))
        .withColumn("rest", F.col("ratio") - F.col("whole"))
        .withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("unit", F.try_divide(F.col("rest") * F.col("source_size"), F.col("source_size") + F.coalesce("short_size", F.lit(0))))
        .select(F.col("source").alias("of"), "source_size", "n", "target", "whole", "extra", "unit")
    )
    small = _sent(plan)
    chance = F.col("unit") * F.when(F.col("size") * F.col("n") <= F.col("source_size"), 2.0).otherwise(1.0)
    quotient = F.when(F.col("p") >= 1, 0.0).otherwise(F.try_divide(F.col("u") / (1 - F.col("u")), F.try_divide(F.col("p"), 1 - F.col("p"))))
    everything = docs.select(*keys, F.struct(*docs.columns).alias("row")) if keep_row else base

    def ranked_rows(rows: DataFrame) -> DataFrame:
        return (
            rows.join(small, F.col("source").eqNullSafe(F.col("of")), "left")
            .withColumn("p", chance)
            .withColumn("open", F.coalesce((F.col("p") > 0) & (F.col("size") > 0), F.lit(False)))
            .withColumn("q", F.when(F.col("open"), quotient))
            .withColumn("cell", F.floor(F.col("q") / (F.col("q") + 1) * CELLS).cast("int"))
        )

    cells = ranked_rows(base).where("open").groupBy(F.col("source").alias("edge_source"), "cell").agg(
        F.first("extra").alias("edge_extra"), F.sum("size").alias("cell_size")
    )
    run = Window.partitionBy("edge_source").orderBy("cell")
    # the cell in which the running size passes the extra words
    edge = durable(
        cells.withColumn("cum", F.sum("cell_size").over(run))
        .where(F.col("cum") > F.col("edge_extra"))
        .groupBy("edge_source")
        .agg(F.min(F.struct("cell", (F.col("cum") - F.col("cell_size")).alias("before"))).alias("edge"))
    )
    ranked = ranked_rows(everything).join(_sent(edge), F.col("source").eqNullSafe(F.col("edge_source")), "left")
    at_edge = F.col("open") & (F.col("cell") == F.col("edge.cell"))
    inside = F.col("open") & F.coalesce(F.col("cell") < F.col("edge.cell"), F.lit(True))
    cum = F.col("edge.before") + F.sum("size").over(Window.partitionBy("source").orderBy("q", F.col("doc_id").asc_nulls_last(), "tie").rowsBetween(Window.unboundedPreceding, 0))
    inner = ranked.where(at_edge).withColumn("more", (cum - F.col("size") * 0.5 <= F.col("extra")).cast("long"))
    outer = ranked.where(~F.coalesce(at_edge, F.lit(False))).withColumn("more", F.coalesce(inside.cast("long"), F.lit(0)))
    copies = (F.when(F.col("size") > 0, F.col("whole") + F.col("more")).otherwise(0)).cast("long")
    return outer.unionAll(inner).select(
        "doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *["row"] * keep_row
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each input row as often as it was taken, with its own columns."""
    taken = mix(docs, keep_row=True, **how).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def _sent(sources: DataFrame, most: int = 20_000) -> DataFrame:
    """Marked to go to every task if it has at most ``most`` rows, which is counted; else as it is."""
    return F.broadcast(sources) if sources.limit(most + 1).count() <= most else sources


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS whole FROM w),
v AS (SELECT *, (whole - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM r),
o AS (SELECT level AS open_level FROM v WHERE ratio > level ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT v.source, source_size, n, CASE WHEN ratio > level THEN (SELECT open_level FROM o) * weight ELSE cap END AS target FROM v),
m AS (SELECT d.*, t.source_size, t.n, t.target, d.size * t.n <= t.source_size AS short FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio,
             sum(CASE WHEN short THEN size ELSE 0 END) OVER (PARTITION BY source) AS short_size FROM m),
q AS (SELECT *, floor(ratio) AS whole, target - floor(ratio) * source_size AS extra,
             (ratio - floor(ratio)) * source_size / (source_size + short_size) * CASE WHEN short THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS p FROM p),
k AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN CASE WHEN p >= 1 THEN 0.0::DOUBLE ELSE (u / (1 - u)) / (p / (1 - p)) END END AS q FROM q),
c AS (SELECT *, sum(CASE WHEN q IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM k)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size > 0 THEN whole + CASE WHEN q IS NOT NULL AND cum - size * 0.5::DOUBLE <= extra THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) * size AS taken
FROM c
"""
