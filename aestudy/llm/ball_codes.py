"""Compression of vectors to one byte per part, with codebooks from ball k-means.

Vectors are cut into equal parts, and every part position has a codebook of its own. Rounds of k-means
are exact: components are integers, distances are squared Euclidean ones, ties go to the lower index.
After the first assignment a round does not compare a part with every entry:

* An entry's ball holds the parts assigned to it. Its radius is bounded by the greatest distance of its
  members to the entry's last place, plus how far the entry has moved. Only entries within twice that
  radius are its neighbours.
* A part that is nearer to its entry than half the way to the nearest neighbour lies in the stable core
  and stays without any work.
* Of the others, the ring between half the way to one neighbour and half the way to the next says which
  neighbours are candidates: those whose distance from the entry is at most twice the part's.

Every round is one pass over the vectors (numpy in tasks, which get the codebooks: entries x components
numbers, whatever the table) and one aggregate of integer sums per entry, whose result, of that same
size, comes back to the driver. Codes of a round are checkpointed with the vectors.

Rows whose vector is null or has null or non-finite components are left out, and so are those whose
length differs from that of the row with the smallest identifier. Identifiers are ordered with null last,
equal ones by vector; rows that repeat count each. Integers are held to 2^24 on both sides, so that sums of
squares fit 64 bits. With fewer rows than entries the codebook has one entry per row. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aestudy.sources.checkpoints import cut_lineage

SCALE = 1024
MOST = 1 << 24
#: Components below this give distances that doubles hold exactly (parts of up to 2048 components).
EXACT_IN_DOUBLES = 1 << 19
WIDEST_PART = 2048
FAR = 1 << 62
MEMBERS_A_BLOCK = 64


def scaled_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """vec_id, label and q, the components' floor(1024 x), of the rows with a finite vector."""
    label = F.lit(None).cast("int") if label_col is None else F.col(label_col)
    own = vectors.select(F.col(id_col).alias("vec_id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("x"))

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            sizes = np.diff(column.offsets.to_numpy())
            values = column.flatten().to_numpy(zero_copy_only=False)
            sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, sizes)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            bad = np.zeros(batch.num_rows, dtype=bool)
            bad[row[~np.isfinite(values)]] = True
            keep = ~(bad | column.is_null().to_numpy(zero_copy_only=False))
            whole = np.clip(np.floor(values[keep[row]] * SCALE), -MOST, MOST).astype(np.int32)
            edges = np.concatenate([[0], np.cumsum(sizes[keep])]).astype(np.int32)
            kept = pa.array(keep)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(whole))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept), lists], names=["vec_id", "label", "q"])

    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    return own.mapInArrow(scale, f"vec_id {kinds['vec_id']}, label {kinds['label']}, q array<int>")


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``."""
    return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)


def nearest(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of every row by comparing with all of them."""
    out = np.empty(len(x), dtype=np.int32)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = squares(x[at : at + 4096], entries).argmin(axis=1)
    return out


def neighbours(entries: np.ndarray, radius: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per entry the entries within twice its ball's radius, nearest first, and their squared distances."""
    gaps = squares(entries, entries)
    out = []
    for j, row in enumerate(gaps):
        order = np.argsort(row, kind="stable")
        order = order[(order != j) & (np.sqrt(row[order].astype(float)) <= 2 * radius[j] * (1 + 1e-9) + 1e-6)]
        out.append((order, row[order]))
    return out


def nearest_in_balls(x: np.ndarray, own: np.ndarray, entries: np.ndarray, around: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The nearest entry of every row, which the last round gave to entry ``own``."""
    best = own.astype(np.int32)
    distance = ((x - entries[own]) ** 2).sum(axis=1)
    order = np.argsort(own, kind="stable")
    edges = np.searchsorted(own[order], np.arange(len(entries) + 1))
    for j in np.flatnonzero(np.diff(edges)):
        ids, gaps = around[j]
        members = order[edges[j] : edges[j + 1]]
        ring = np.searchsorted(gaps, 4 * distance[members], side="right")  # 0: the stable core
        members, ring = members[ring > 0], ring[ring > 0]
        outward = np.argsort(ring, kind="stable")
        for at in range(0, len(members), MEMBERS_A_BLOCK):
            part = outward[at : at + MEMBERS_A_BLOCK]
            rows, widest = members[part], ring[part[-1]]
            to = squares(x[rows], entries[ids[:widest]])
            to[np.arange(widest) >= ring[part][:, None]] = FAR
            least = to.min(axis=1)
            which = np.where(to == least[:, None], ids[:widest], len(entries)).min(axis=1)
            better = (least < distance[rows]) | ((least == distance[rows]) & (which < j))
            best[rows[better]] = which[better]
    return best


def batch_parts(batch: pa.RecordBatch, at: int, dim: int, books: np.ndarray) -> np.ndarray:
    """Rows x parts x width, as doubles where these are exact."""
    values = batch.column(at).flatten().to_numpy().reshape(batch.num_rows, dim)
    small = max(np.abs(values).max(initial=0), np.abs(books).max()) < EXACT_IN_DOUBLES
    return values.reshape(batch.num_rows, books.shape[0], -1).astype(np.float64 if small else np.int64)


class BallKMeans:
    """Codebooks (parts x entries x width) and, once parts have been assigned, the balls' radii."""

    def __init__(self, books: np.ndarray) -> None:
        self.books = books.astype(np.int64)
        self.radius: np.ndarray | None = None

    def assign(self, state: DataFrame) -> DataFrame:
        """``state`` (vec_id, label, q, and codes after the first round) with new codes."""
        books, radius = self.books, self.radius
        parts, _, width = books.shape
        kinds = {f.name: f.dataType.simpleString() for f in state.schema}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            around = None if radius is None else [neighbours(books[p], radius[p]) for p in range(parts)]
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch_parts(batch, 2, parts * width, books)
                codes = np.empty((batch.num_rows, parts), dtype=np.int32)
                old = None if radius is None else batch.column(3).flatten().to_numpy().reshape(-1, parts)
                for p in range(parts):
                    entries = books[p].astype(x.dtype)
                    own = np.ascontiguousarray(x[:, p])
                    codes[:, p] = nearest(own, entries) if old is None else nearest_in_balls(own, old[:, p], entries, around[p])
                edges = np.arange(0, codes.size + 1, parts, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=["vec_id", "label", "q", "codes"])

        return state.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, q array<int>, codes array<int>")

    def update(self, state: DataFrame) -> None:
        """Move the entries to the floor of their parts' means; entries without parts stay."""
        books = self.books
        parts, size, width = books.shape

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((parts, size, width + 2), dtype=np.int64)  # components, count, greatest distance
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch_parts(batch, 2, parts * width, books).astype(np.int64)
                codes = batch.column(3).flatten().to_numpy().reshape(-1, parts)
                for p in range(parts):
                    np.add.at(sums[p, :, :width], codes[:, p], x[:, p])
                    sums[p, :, width] += np.bincount(codes[:, p], minlength=size)
                    np.maximum.at(sums[p, :, width + 1], codes[:, p], ((x[:, p] - books[p, codes[:, p]]) ** 2).sum(axis=1))
            used = np.flatnonzero(np.repeat(sums[:, :, width] > 0, width + 2))
            yield pa.RecordBatch.from_pydict({"cell": used, "value": sums.ravel()[used]})

        cells = state.mapInArrow(total, "cell long, value long").groupBy("cell").agg(F.sum("value").alias("total"), F.max("value").alias("most"))
        totals = np.zeros((parts, size, width + 2), dtype=np.int64)
        for cell, added, most in cells.collect():
            totals.flat[cell] = most if cell % (width + 2) == width + 1 else added
        count = totals[:, :, width]
        moved = np.where(count[:, :, None] > 0, totals[:, :, :width] // np.maximum(count, 1)[:, :, None], books)
        drift = np.sqrt(((moved - books) ** 2).sum(axis=2).astype(float))
        self.radius = np.sqrt(totals[:, :, width + 1].astype(float)) + drift
        self.books = moved

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def fit_codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> tuple[DataFrame, BallKMeans | None]:
    """vec_id, label, q and codes (0-based entries in the order of the parts), and the fitted codebooks."""
    if not 1 <= entries <= 256 or parts < 1 or rounds < 0:
        raise ValueError("a code is one byte, parts at least one, rounds not negative")
    state = cut_lineage(scaled_vectors(vectors, id_col, vector_col, label_col))
    by_id = (F.col("vec_id").asc_nulls_last(), F.col("q"))
    first = state.orderBy(*by_id).select(F.size("q")).first()
    if first is None:
        return state.withColumn("codes", F.array().cast("array<int>")), None
    dim = first[0]
    if not dim or dim % parts or dim // parts > WIDEST_PART:
        raise ValueError(f"vectors of {dim} components do not give {parts} parts of 1 to {WIDEST_PART}")
    state = state.where(F.size("q") == dim)
    seeds = np.array([r["q"] for r in state.orderBy(*by_id).limit(entries).select("q").collect()], dtype=np.int64)
    model = BallKMeans(seeds.reshape(len(seeds), parts, dim // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        state = cut_lineage(model.assign(state))
        model.update(state)
    return cut_lineage(model.assign(state)), model


def compress_vectors(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """vec_id, code (two hexadecimal digits per part), error, label_error and codebooks_sha256."""
    state, model = fit_codes(vectors, parts, entries, rounds, id_col, vector_col, label_col)
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    books = np.zeros((parts, 1, 1), dtype=np.int64) if model is None else model.books

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch_parts(batch, 2, books.shape[0] * books.shape[2], books).astype(np.int64)
            codes = batch.column(3).flatten().to_numpy().reshape(-1, parts)
            error = sum(((x[:, p] - books[p, codes[:, p]]) ** 2).sum(axis=1) for p in range(parts))
            text = codes.astype(np.uint8).tobytes().hex()
            hexes = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hexes, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    coded = cut_lineage(state.mapInArrow(write, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"))
    by_label = coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("same")))
    digest = F.lit(None if model is None else model.digest()).cast("string")
    return joined.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))
