"""Exact deduplication: a tree merge of sorted digest runs. DataFrame functions only.

Every scan partition's digests become a run: sorted, one row a digest, with the smallest identifier and the number of rows.
Runs are numbered in base `fan_in`, and a run's pieces are the ranges of its digests by their leading digits in that base.
In round r the fan_in partitions whose numbers differ in digit r only exchange pieces: each gets from all of them the
piece that its own digit r names, merges the sorted pieces in order, verifies equal digests and keeps the smallest
identifier of each. So each round halves (fan_in = 2; by default quarters) the number of runs that still overlap while
every partition keeps its share of the digests, and no partition ever holds a root. After the last round partition p has
the digests that begin with p's digits, one row each. A digest that holds a third of all rows is one row a run before
anything meets. Each level's runs are written to the shared folder, so a lost executor costs no earlier round.

SHA-256 alone never decides: the length and a second hash of the normalised text travel with it and must agree too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, carried, dropped, written

FAN_IN = 4
_KEY = ["_sha", "_len", "_alt"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, _sha, _len, _alt, _run): one narrow row a document, written once and used by every later step."""
    norm = df.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm"))
    return written(
        norm.select(
            F.col("_id").alias(id_col),
            F.unhex(F.sha2("_norm", 256)).alias("_sha"),
            F.length("_norm").cast("long").alias("_len"),
            F.xxhash64("_norm").alias("_alt"),
            F.spark_partition_id().alias("_run"),
        ),
        "digests",
    )


def merged_runs(pieces: DataFrame, n_runs: int) -> DataFrame:
    """One sorted run a partition, from pieces (_KEY, keep_id, group_size, _run: the partition they go to)."""
    same = Window.partitionBy("_run", *_KEY).orderBy(F.asc_nulls_last("keep_id"))
    order = [*[F.asc(c) for c in ("_run", *_KEY)], F.asc_nulls_last("keep_id")]
    rows = F.sum("group_size").over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    met = pieces.repartitionById(n_runs, F.col("_run").cast("int")).sortWithinPartitions(*order)
    first = met.withColumn("_rows", rows).withColumn("_nth", F.row_number().over(same)).filter("_nth = 1")
    return first.select(*_KEY, "keep_id", F.col("_rows").alias("group_size"), "_run")


def rounds_of(n_runs: int, fan_in: int) -> int:
    rounds = 0
    while fan_in**rounds < n_runs:
        rounds += 1
    return rounds


def tree_merge(runs: DataFrame, id_col: str, fan_in: int = FAN_IN) -> DataFrame:
    """One row a digest: (_sha, _len, _alt, keep_id, group_size). fan_in is a power of two."""
    if fan_in < 2 or fan_in & (fan_in - 1):
        raise ValueError("fan_in is a power of two")
    n_scan = (runs.agg(F.max("_run")).first()[0] or 0) + 1
    rounds, bits = rounds_of(n_scan, fan_in), fan_in.bit_length() - 1
    level = runs.select(*_KEY, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "_run")
    level = written(merged_runs(level, n_scan), "runs")
    leading = F.conv(F.hex(F.substring("_sha", 1, 7)), 16, 10).cast("long")
    for r in range(rounds):
        place = fan_in ** (rounds - 1 - r)
        digit = F.shiftright(leading, 56 - bits * (r + 1)).bitwiseAND(F.lit(fan_in - 1))
        partner = F.col("_run") + (digit - F.floor(F.col("_run") / place) % fan_in) * place
        level, old = written(merged_runs(level.withColumn("_run", partner.cast("int")), fan_in**rounds), "runs"), level
        dropped(old)
    return level.drop("_run")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of df: id_col, keep_id, group_size, kept, text_sha256.

    Null and empty texts are the same text. Of equal texts the row with the smallest identifier stays; null identifiers
    never win over others, and rows repeated with the same identifier and text are the same document, each `kept`. An
    empty table gives an empty result; columns other than the two named are not read.
    """
    runs = digests(df, id_col, text_col)
    keep = tree_merge(runs, id_col, fan_in)
    return runs.join(keep, _KEY).select(
        id_col,
        "keep_id",
        "group_size",
        F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def unique_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows that exact_dedup drops (one row of each repeated row stays); df's own columns, whatever their names.

    A null text is an empty one. A null identifier loses to any other; where all of equal texts have none, one row stays.
    Among rows with the kept identifier and equal texts, one stays. An empty table gives an empty one.

    A dropped row is one whose identifier and text are; where identifiers are unique and not null, the identifier tells it.
    """
    runs = digests(df, id_col, text_col)
    keep = tree_merge(runs, id_col)
    lost = runs.join(keep, _KEY).filter(~F.col(id_col).eqNullSafe(F.col("keep_id"))).select(F.col(id_col).alias("_lost"), *[F.col(c).alias(f"_lost{c}") for c in _KEY])
    counts = runs.groupBy(id_col).count().agg(F.max("count"), F.max(F.col(id_col).isNull())).first()
    if (counts[0] or 0) <= 1 and not counts[1]:
        return carried(df, _id=F.col(id_col)).join(lost, F.col("_id").eqNullSafe(F.col("_lost")), "left_anti").select("_row.*")
    norm = normalised(F.col(text_col))
    key = {"_sha": F.unhex(F.sha2(norm, 256)), "_len": F.length(norm).cast("long"), "_alt": F.xxhash64(norm)}
    same = F.col("_id").eqNullSafe(F.col("_lost"))
    for c in _KEY:
        same = same & (F.col(c) == F.col(f"_lost{c}"))
    out = carried(df, _id=F.col(id_col), _text=F.col(text_col), **key).join(lost, same, "left_anti")
    return out.dropDuplicates(["_id", "_text"]).select("_row.*")
