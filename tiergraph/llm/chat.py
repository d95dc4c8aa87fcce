"""Chat formatting with collapse of cumulative snapshots, in DataFrame functions alone.

Logs often store a conversation again after each turn.  A rolling hash of every turn prefix (an exclusive-or
of position-tagged turn hashes, 128 bits) tells which stored conversations are a proper prefix of a longer
one; an anti-join leaves the maximal ones, of equal conversations the one with the least conv_id, and these
are rendered.  Only hashes are compared; texts move once, for the conversations that are left.  Equal
prefixes are reduced before they are shuffled, so a first turn or a conversation that very many rows share
is one row.  The turns of one conversation meet in one task, since its rendering is one value.

Defined cases: a null conv_id is a conversation of its own; null roles are rendered as "unknown", null
texts as empty, and both differ from those words in comparisons; turns are ordered by turn, then role,
then the text's MD5, nulls first, and repeated rows are repeated turns; empty tables give an empty result;
other columns are ignored; texts of any length are hashed and rendered whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiergraph.llm.tables import named

#: The marks around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Maximal conversations: conv_id, n_turns, n_copies (equal stored ones), rendered."""
    base = turns.select(F.col(named(conv_id)).alias("conv_id"), F.col(named(turn)).alias("turn"), F.col(named(role)).cast("string").alias("role"), F.col(named(text)).cast("string").alias("text"))
    # A null and an empty value hash apart by the flags.
    content = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    base = base.withColumn("digest", F.md5("text"))
    hashed = base.select("conv_id", "turn", "role", "digest", F.xxhash64(F.lit("first"), *content).alias("h1"), F.xxhash64(F.lit("second"), *content[::-1]).alias("h2"))
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy("turn", "role", "digest")  # nulls first
    placed = hashed.withColumn("place", F.row_number().over(order)).withColumn("n", F.count("*").over(whole))
    rolling = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefixes = placed.select(
        "conv_id",
        "place",
        "n",
        F.expr("bit_xor(xxhash64(place, h1))").over(rolling).alias("p1"),
        F.expr("bit_xor(xxhash64(h2, place))").over(rolling).alias("p2"),
    )
    stored = prefixes.where("place = n").groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    shorter = prefixes.where("place < n").select(F.col("place").cast("long").alias("n"), "p1", "p2").distinct()
    maximal = stored.join(shorter, ["n", "p1", "p2"], "left_anti").select(F.col("conv_id").alias("kept"), "n_copies")

    line = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n"))
    lines = base.select("conv_id", F.struct("turn", "role", "digest", line.alias("line")).alias("entry"))
    left = lines.join(maximal, F.col("conv_id").eqNullSafe(F.col("kept")))
    grouped = left.groupBy("conv_id", "n_copies").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    return grouped.select("conv_id", F.size("entries").cast("long").alias("n_turns"), "n_copies", F.array_join(F.col("entries.line"), "").alias("rendered"))
