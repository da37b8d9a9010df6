"""Where what was written on a symbol belongs after the symbol was moved, again and again.

A log of moves (seq, src, dst, at) is a forest: each move is followed by the first later one that leaves the place it came to.
Time only grows along it, so moves in a circle end where the last one leads.  Each move's end is found by doubling: pointers
are followed by the pointers of what they point to, which takes as many rounds as the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import saved
from .order import carried


def _next(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """rows (id, place, at, seq) with `move`, the first of moves that leaves the place after (at, seq)."""
    leaving = moves.select(F.lit(None).cast("string").alias("id"), F.col("src").alias("place"), "at", "seq", F.col("seq").alias("move"))
    both = rows.select(F.col("id").cast("string"), "place", "at", "seq", F.lit(None).cast("long").alias("move")).unionByName(leaving)
    # latest first, so that what is carried is the nearest move that comes after; at equal keys the rows come before the moves that they aren't after
    order = [F.col("at").desc(), F.col("seq").desc(), F.col("move").isNotNull().asc()]
    return carried(both, "place", order, F.col("move"), "next").where("id IS NOT NULL").select("id", "place", "at", "seq", F.col("next").alias("move"))


def ends(moves: DataFrame) -> DataFrame:
    """(seq, dst, last, hops): where each move leads in the end, the last move on the way, and how many there are."""
    arrived = moves.select(F.col("seq").alias("id"), F.col("dst").alias("place"), "at", "seq")
    link = _next(arrived, moves).select("seq", F.col("move").alias("to"))
    ptr = saved(link.select("seq", F.coalesce("to", "seq").alias("to"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("hops")), "pointers")
    while True:
        ahead = ptr.select(F.col("seq").alias("to"), F.col("to").alias("on"), F.col("hops").alias("more"))
        new = saved(ptr.join(ahead, "to").select("seq", F.col("on").alias("to"), (F.col("hops") + F.col("more")).alias("hops")), "pointers")
        if new.join(ptr.select("seq", F.col("to").alias("was")), "seq").where("to <> was").isEmpty():
            break
        ptr = new
    last = moves.select(F.col("seq").alias("to"), "dst")
    return new.join(last, "to").select("seq", "dst", F.col("to").alias("last"), (F.col("hops") + 1).alias("hops"))


def rebound(entries: DataFrame, moves: DataFrame, as_of: Column) -> DataFrame:
    """(entry_id, moved_from, symbol_id, hops) of entries (entry_id, symbol_id, at, seq) as of a time, and of a row for each move.

    An entry has one owner, the symbol that its own one has become; a move's own row stands on what it led to and moves on.
    """
    known = saved(moves.where(F.col("at") <= as_of).select("seq", "src", "dst", "at"), "moves")
    reached = saved(ends(known), "ends")
    own = _next(entries.select(F.col("entry_id").alias("id"), F.col("symbol_id").alias("place"), "at", "seq"), known)
    found = own.join(reached.select(F.col("seq").alias("move"), "dst", "hops"), "move", "left")
    rows = found.select(F.col("id").alias("entry_id"), F.col("place").alias("moved_from"), F.coalesce("dst", "place").alias("symbol_id"), F.coalesce("hops", F.lit(0)).cast("long").alias("hops"))
    written = known.join(reached.select("seq", F.col("dst").alias("owner"), "hops"), "seq")
    return rows.unionByName(written.select(F.concat(F.lit("rebind_"), "seq").alias("entry_id"), F.col("src").alias("moved_from"), F.col("owner").alias("symbol_id"), F.col("hops").cast("long").alias("hops")))
