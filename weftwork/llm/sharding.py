"""Sharding by proportional stratified interleaving: every shard holds the mixture of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import col, free, numbered, ordered_totals, query, read, source_key, stage
from weftwork.llm.mixing import shuffle_key

SHARDS = 40
SEED = 2


def places(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(``row``, ``g`` source, ``k`` shuffle key) → (``row``, ``shard``, ``slot``).

    Rows are ranked by their shuffle key inside each source; row r of n gets the fraction (r + 1/2) / n,
    and all rows are ordered by it (equal fractions: by source). Shard i takes places i·N/shards up to the
    next, so counts are at most one apart and each shard holds each source in its share to within a row or two.
    """
    ranked = ordered_totals(rows.withColumn("one", F.lit(1)), ["k", "row"], {"rank": "one"}, group="g")
    counts = stage(rows.groupBy("g").agg(F.count("*").alias("n")), "counts")
    spread = ranked.join(counts, "g").select("row", "g", "one", ((F.col("rank") + 0.5) / F.col("n")).alias("fraction"))
    ordered = ordered_totals(spread, ["fraction", "g"], {"place": "one"})
    whole = max(1, counts.agg(F.sum("n")).first()[0] or 0)
    cut = F.expr(f"((place + 1) * {int(shards)}L - 1) div {whole}L").cast("int")
    return ordered.withColumn("shard", cut).select("row", "shard", F.expr(f"place - (shard * {whole}L) div {int(shards)}").cast("bigint").alias("slot"))


def shard(docs: DataFrame, shards: int = SHARDS, doc_id="doc_id", text="text", source="source", seed: int = SEED) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, … inside the shard) added as the last two columns.

    Rows are written once with a row number; only narrow rows are ranked, and the result is joined back on
    the number. A NULL source is a stratum of its own, NULL and empty texts are rows like others, repeated rows
    get slots of their own, an empty table gives no rows. A clashing column of ``docs`` keeps its name.
    With fewer rows than shards some shards stay empty.
    """
    row = free(docs, "_row")
    staged = numbered(docs, row, "shard")
    narrow = staged.select(F.col(row).alias("row"), source_key(col(source)).alias("g"), shuffle_key(seed, col(doc_id), col(text)).alias("k"))
    placed = places(narrow, shards)
    placed = placed.select(*[F.col(c).alias(free(staged, f"_at_{c}")) for c in placed.columns])
    at_row, at_shard, at_slot = placed.columns
    return (staged.join(placed, F.col(row) == F.col(at_row))
            .select(*[col(c) for c in docs.columns], F.col(at_shard).alias(free(docs, "shard")), F.col(at_slot).alias(free(docs, "slot"))))


@query("op2_shard_interleave")
def op2(spark, root):
    """Whole texts go through the operator; size and checksum are taken from what it returns."""
    out = shard(read(spark, root, "documents").select("doc_id", "text", "source"))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint")
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).cast("bigint")
    return out.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
