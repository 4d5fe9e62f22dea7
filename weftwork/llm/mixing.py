"""Mixing sources to target weights: hash-random order, distributed prefix sums, a cut at each source's budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import col, free, ordered_totals, query, read, source_key, stage, word_count
from weftwork.operators.keys import dense_index

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 1


def shuffle_key(seed: int, doc_id: Column, text: Column) -> Column:
    """A random but repeatable order of rows; equal rows share it."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, cap: float = CAP) -> DataFrame:
    """(source key ``g``, ``source_size``) → adds ``target``, the words that the mix takes from the source.

    Weights repeat over the sources in order of their key. All targets together are ``share`` of all
    words; none is above ``cap`` times its source, and what is cut off goes to the others by weight.
    With sources ordered by cap/weight, those at their cap are a prefix, and the level of the others
    is the largest of (words left) / (weight left) over all prefixes: prefix sums, no rounds.
    """
    ranked = dense_index(sizes, ["g"], "_rank", start=0)
    ranked = (ranked.withColumn("_weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")))
              .withColumn("_cap", cap * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_weight")))
    before = stage(ordered_totals(ranked, ["_ratio", "g"], {"_caps": "_cap", "_weights": "_weight"}), "targets")
    whole = before.agg(F.sum("source_size"), F.sum("_weight")).first()
    room = F.lit((whole[0] or 0) * float(share)) - F.col("_caps")
    level = before.agg(F.max(room / (F.lit(whole[1] or 0) - F.col("_weights")).cast("double"))).first()[0] or 0.0
    return before.select("g", "source_size", F.least(F.col("_cap").cast("double"), F.lit(float(level)) * F.col("_weight")).alias("target"))


def mix_plan(docs: DataFrame, doc_id="doc_id", text="text", source="source", weights=WEIGHTS, share: float = 1.0, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """One row a source: ``g``, ``source_size``, ``target``, ``full`` (whole epochs), ``cut`` (last key of the part epoch, or NULL).

    In the last epoch a document is taken when the middle of its words lies within what the budget has
    left, so a source misses its target by half a document at most. Equal rows count as one unit.
    Documents without words have no weight in the sums.
    """
    narrow = docs.select(source_key(col(source)).alias("g"), shuffle_key(seed, col(doc_id), col(text)).alias("k"), word_count(col(text)).alias("size"))
    units = stage(narrow.groupBy("g", "k").agg(F.sum("size").alias("size")), "units")
    plan = stage(targets(units.groupBy("g").agg(F.sum("size").alias("source_size")), weights, share, cap)
                 .withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
                 .withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")), "plan")
    summed = ordered_totals(units, ["k"], {"before": "size"}, group="g")
    inside = summed.join(plan.select("g", "rest"), "g").where((F.col("rest") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("rest")))
    cuts = inside.groupBy("g").agg(F.max("k").alias("cut"))
    return stage(plan.join(cuts, "g", "left").select("g", "source_size", "target", "full", "cut"), "plan")


def mix(docs: DataFrame, doc_id="doc_id", text="text", source="source", weights=WEIGHTS, share: float = 1.0, cap: float = CAP, seed: int = SEED,
        size="size", source_size="source_size", target="target", copies="copies") -> DataFrame:
    """Every row of ``docs`` with how often the mix takes it (``copies``, 0 to ``cap``), its words and its source's figures.

    The text itself is never shuffled: the plan has one row a source and the cut is a comparison of keys.
    A NULL text has no words; a NULL source is a source of its own, the last; an empty table gives no rows;
    a source without words has target 0. A clashing column of ``docs`` keeps its name and the new column
    gets an underscore; the added columns are the last four.
    """
    plan = mix_plan(docs, doc_id, text, source, weights, share, cap, seed)
    g, k = free(docs, "_g"), free(docs, "_k")
    plan = plan.select(*[F.col(c).alias(free(docs, f"_plan_{c}")) for c in plan.columns])
    pg, psize, ptarget, pfull, pcut = plan.columns
    keyed = docs.withColumn(g, source_key(col(source))).withColumn(k, shuffle_key(seed, col(doc_id), col(text)))
    part = F.when(F.col(k) <= F.col(pcut), 1).otherwise(0)
    return (keyed.join(plan, F.col(g) == F.col(pg))
            .select(*[col(c) for c in docs.columns], word_count(col(text)).alias(free(docs, size)), F.col(psize).alias(free(docs, source_size)),
                    F.col(ptarget).alias(free(docs, target)), (F.col(pfull) + part).cast("int").alias(free(docs, copies))))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, columns unchanged."""
    out = mix(docs, **options)
    return out.where(F.col(out.columns[-1]) > 0).withColumn(free(out, "_copy"), F.explode(F.sequence(F.lit(1), F.col(out.columns[-1])))).select(*[col(c) for c in docs.columns])


_SQL = """
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'z' ELSE 's' || source END AS g,
    md5('1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS k,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT g, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY g) - 1 AS r FROM d GROUP BY g),
w AS (SELECT g, source_size, [5, 2, 1][CAST(r % 3 AS INT) + 1] AS weight, 3 * source_size AS cap FROM s),
b AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
    coalesce(sum(weight) OVER (ORDER BY cap / weight, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights,
    sum(source_size) OVER () AS total, sum(weight) OVER () AS total_weight FROM w),
l AS (SELECT *, max(CAST(total - caps AS DOUBLE) / CAST(total_weight - weights AS DOUBLE)) OVER () AS level FROM b),
t AS (SELECT g, source_size, least(CAST(cap AS DOUBLE), level * weight) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS n FROM t),
u AS (SELECT g, k, sum(size) AS size FROM d GROUP BY g, k),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY g ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u)
SELECT d.doc_id, d.size, e.source_size, e.target,
  CAST(d.size * (e.n + CASE WHEN e.target - e.n * e.source_size > 0 AND c.before + c.size / 2 <= e.target - e.n * e.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN e USING (g) JOIN c ON c.g = d.g AND c.k = d.k
"""


@query("op10_mix_sources", _SQL)
def op10(spark, root):
    docs = read(spark, root, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
