"""Small helpers of the text operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that end a word, as code points: space and tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the identifier and the text, a null text as an empty one; other columns are not read."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def fresh_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores in front until no column is called so."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def in_fold(id_col: Column, folds: int) -> Column:
    """Whether the crc32 of the identifier, written as text, leaves the remainder 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def slices(items: list, sizes: Iterable[int], most: int) -> Iterable[tuple[int, int]]:
    """Ranges of ``items`` whose sizes add up to about ``most``, at least one item each."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(items):
        yield start, len(items)


def keep_rows(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose identifier and text ``decisions`` (doc_id, text_sha256, kept) keeps, each once."""
    key = fresh_name("row_key", docs.columns)

    def row_key(own_id: Column, digest: Column) -> Column:
        return F.concat(F.coalesce(own_id.cast("string"), F.lit("-")), F.lit(":"), digest).alias(key)

    digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
    kept = decisions.where("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")))
    return docs.withColumn(key, row_key(F.col(id_col), digest)).join(kept, key, "left_semi").dropDuplicates([key]).drop(key)
