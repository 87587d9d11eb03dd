"""The end of every redirect chain, by pointer jumping.

A redirect table (from_url, to_url) says where one answer pointed.  Every URL keeps the
place it has reached; in a round each unfinished URL jumps to the place that its place
has reached, so a chain of n redirects takes about log2(n) rounds.  A URL whose place has
no redirect is finished.  A chain of finite length holds URLs of every shorter
length, so as long as one is left some URL finishes in each round; once none does, all
that are left run into loops.

Each round is checkpointed: a lost executor re-reads the table of the last round.
The joins are plain equi-joins with unique keys on one side; AQE splits a hot place (a
login page that a third of all URLs redirect to).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import ensure_checkpoint_dir

MAX_REDIRECTS = 30  # fixed value: what the usual HTTP client follows


def redirect_ends(redirects: DataFrame, max_hops: int = MAX_REDIRECTS) -> DataFrame:
    """(url, final_url, hops, outcome) for every URL that redirects.

    ``outcome``: ``ok``, ``loop`` or ``redirects`` (more than ``max_hops``); only ``ok`` has
    a ``final_url``, loops have no ``hops``.  Of several targets of one URL the smallest
    counts; rows without a URL or target do not."""
    ensure_checkpoint_dir(redirects.sparkSession)
    named = (F.col("from_url") != "") & (F.col("to_url") != "")
    state = (redirects.where(named).groupBy(F.col("from_url").alias("url"))
             .agg(F.min("to_url").alias("at"), F.lit(1).cast("long").alias("hops"), F.lit(False).alias("done"))
             .checkpoint(eager=True))
    finished = -1
    while True:
        now, total = state.agg(F.count_if("done"), F.count(F.lit(1))).first()
        if now == total or now == finished:
            break
        finished = now
        step = state.select(F.col("url").alias("_from"), F.col("at").alias("_at"), F.col("hops").alias("_hops"), F.col("done").alias("_done"))
        jumped = state.where("NOT done").join(step, F.col("at") == F.col("_from"), "left").select(
            "url", F.coalesce("_at", "at").alias("at"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
            F.coalesce("_done", F.lit(True)).alias("done"))
        state = state.where("done").unionByName(jumped).checkpoint(eager=True)
    outcome = F.when(~F.col("done"), F.lit("loop")).when(F.col("hops") > max_hops, F.lit("redirects")).otherwise(F.lit("ok"))
    return state.select("url", F.when(outcome == "ok", F.col("at")).alias("final_url"),
                        F.when(F.col("done"), F.col("hops")).alias("hops"), outcome.alias("outcome"))
