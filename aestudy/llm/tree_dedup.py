"""Exact deduplication by a tree of merges over runs of digests.

Every row gets the SHA-256 digest of its text and belongs to one of ``runs`` runs by a hash of its
identifier. A run holds one row per distinct text: digest, length and a second hash (which must agree
too, so that a digest is never believed alone), the identifier that stays so far and the number of
rows. In each round ``fan_in`` neighbouring runs are exchanged, by (parent run, digest), and merged
into their parent's run, which is kept sorted by digest; only the surviving identifier of a text
goes on. After log(runs) rounds the root holds one row per text. The way back hands the result from
parent to child runs, so that a text that fills a third of the table is never in one task: at every
level a parent row meets ``fan_in`` child rows at most, and the rows of a text lie in ``runs`` parts.
Texts themselves are read once and never shuffled.

Only DataFrame functions are used. Nulls: a null text counts as an empty one; a null identifier stays
only when all rows of the text have none. Of rows that repeat identifier and text, one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aestudy.sources.checkpoints import cut_lineage

TEXT_KEY = ["digest", "n_bytes", "check"]


def text_digest(text):
    """Digest columns of a text: SHA-256, bytes and a second hash."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return [
        F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"),
        F.octet_length(whole).cast("long").alias("n_bytes"),
        F.xxhash64(whole).alias("check"),
    ]


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    runs: int = 64,
    fan_in: int = 4,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` says whether the largest or the smallest identifier of equal texts stays.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    if runs < 1 or fan_in < 2:
        raise ValueError("at least one run and two runs per merge are needed")
    best = F.max if keep == "largest" else F.min
    rows = docs.select(F.col(id_col).alias("doc_id"), *text_digest(F.col(text_col)))
    rows = rows.withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int"))
    leaf = cut_lineage(rows.groupBy("run", "doc_id", *TEXT_KEY).agg(F.count(F.lit(1)).alias("copies")))

    levels = []
    level = leaf.groupBy("run", *TEXT_KEY).agg(best("doc_id").alias("best"), F.sum("copies").alias("n"))
    left = runs
    while True:
        level = cut_lineage(level.sortWithinPartitions("run", *TEXT_KEY))
        levels.append(level)
        if left == 1:
            break
        left = -(-left // fan_in)
        parents = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        level = parents.groupBy("run", *TEXT_KEY).agg(best("best").alias("best"), F.sum("n").alias("n"))

    found = levels[-1].select("run", *TEXT_KEY, F.col("best").alias("keep_id"), F.col("n").alias("group_size"))
    for level in reversed(levels[:-1]):
        child = level.select(F.col("run").alias("child"), F.floor(F.col("run") / fan_in).cast("int").alias("run"), *TEXT_KEY)
        found = child.join(found, ["run", *TEXT_KEY]).select(F.col("child").alias("run"), *TEXT_KEY, "keep_id", "group_size")
    rows = leaf.join(found, ["run", *TEXT_KEY]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
