"""Exact dedup by two-pass Bloom filtering, with DataFrame functions only.

Pass 1 gives every text a bit of a filter and keeps the bits on which two or more rows fell; what it sends is the number
of the bit, not the digest. Pass 2 looks every row up: only rows whose bit is kept can have a twin, and only their digests
shuffle. The others pass straight through as groups of one. Groups of very many copies are few, so they are broadcast and
their rows stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, free_name, numbered, without_rows

BLOCK = 1 << 15  # bits that bitmap_construct_agg puts into one row of 4 KB
#: Copies from which on a group may be broadcast, and the most groups that are: a group counts as hot only if it has more
#: than one in HOT_GROUPS of all rows.
HOT_COPIES, HOT_GROUPS = 1_000, 1_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def repeated_bits(digests: DataFrame, bits: int) -> DataFrame:
    """block, bits (binary): the bits on which two or more rows fell. Counts are added up before they are sent."""
    at = digests.select(F.pmod("h", F.lit(bits)).alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    block, bit = F.expr(f"at div {BLOCK}").alias("block"), (F.col("at") % BLOCK).alias("bit")
    return at.select(block, bit).groupBy("block").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))


def _is_set() -> Column:
    """Whether the bit at is set. bitmap_construct_agg puts bit b into byte b / 8, there at place b % 8 from the lowest."""
    b = f"(at % {BLOCK})"
    byte = f"cast(conv(hex(substring(bits, cast({b} div 8 as int) + 1, 1)), 16, 10) as int)"
    return F.expr(f"(shiftright({byte}, cast({b} % 8 as int)) & 1) = 1")


def _marked(rows: DataFrame, text: Column, bits_per_row: int, broadcast_mb: int) -> DataFrame:
    """id, row, first (struct id, row), group_size, sha of rows (id, row and what text reads)."""
    digests = cut(rows.select("id", "row", F.sha2(normalised(text), 256).alias("sha")).withColumn("h", F.xxhash64("sha")))
    n = digests.count()
    bits = max(1, -(-n * bits_per_row // BLOCK)) * BLOCK
    filter_ = cut(repeated_bits(digests, bits))
    small = filter_.count() * (BLOCK >> 3) <= broadcast_mb << 20
    at = F.pmod("h", F.lit(bits))
    seen = digests.withColumn("at", at).withColumn("block", F.expr(f"at div {BLOCK}")).join(F.broadcast(filter_) if small else filter_, "block", "left")
    seen = cut(seen.select("id", "sha", "row", F.coalesce(F.col("bits").isNotNull() & _is_set(), F.lit(False)).alias("maybe")))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    groups = cut(seen.where("maybe").groupBy("sha").agg(first, F.count(F.lit(1)).alias("group_size")).where("group_size > 1"))
    least = max(HOT_COPIES, n // HOT_GROUPS)
    hot, cold = groups.where(F.col("group_size") > least), groups.where(F.col("group_size") <= least)
    of_hot = seen.where("maybe").join(F.broadcast(hot), "sha")
    others = seen.where("maybe").join(F.broadcast(hot.select("sha")), "sha", "left_anti").join(cold.hint("merge"), "sha", "left")
    through = seen.where("not maybe").select("sha", "id", "row", "maybe", F.lit(None).cast(groups.schema["first"].dataType).alias("first"), F.lit(None).cast("long").alias("group_size"))
    return of_hot.unionByName(others).unionByName(through)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 32, broadcast_mb: int = 64) -> DataFrame:
    """One row per row of docs: its id, keep_id (the smallest id with an equal text), group_size, kept, text_sha256.

    Texts are equal when their SHA-256 is, after each run of ASCII white space became one space. Null counts as an empty
    text; empty texts equal each other. A row that repeats an id and text stays once (kept on one of them). A null id is
    larger than any other. An empty table gives an empty result. Other columns, whatever their names, are not read.
    The filter has about bits_per_row bits for each row, in blocks of 32,768, of which only blocks with a repeated bit
    are kept; it is broadcast only if these are at most broadcast_mb, else the digests are joined with it by block.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.monotonically_increasing_id().alias("row"))
    got, alone = _marked(rows, F.col("text"), bits_per_row, broadcast_mb), F.col("first").isNull()
    return got.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("first.row") == F.col("row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names. Rows are told apart by number, so that of
    rows that repeat an id and text, or have a null id, one stays."""
    row = free_name(docs, "row_number")
    docs = numbered(docs, row)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.col(row).alias("row"))
    gone = cut(_marked(rows, F.col("text"), 32, 64).where("first is not null and first.row != row").select(F.col("row").alias(row)))
    return without_rows(docs, row, gone)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
