"""Mixture-controlled packing: deficit round-robin over source queues, worked out by prefix sums.

Every source is a queue of its documents' tokens, in the order of the encoded rows. In each window of
``most`` tokens a queue earns credit in proportion to its target share. It sends what it has earned when that
is at least ``least`` tokens; less is carried on as its deficit, and so is what rounding leaves, so over any
number of windows a queue is within ``least`` tokens of its share (small queues take turns at staggered
windows). By default the targets are the sources' own shares of all tokens, so that all queues last to the end.
With targets given, a queue that runs dry leaves its share to the others, and sources without a target
follow when all named ones are done.

Nothing runs through the queues one after another: what a queue has earned by a window is a function of the
window, so the windows of a document follow from the tokens before it in its queue, a prefix sum over
blocks of rows (the credit and deficit carried over from one partition to the next). A second prefix
sum, over windows and queues, gives every piece its place in the whole stream, which is cut every ``most``
tokens; the rest at the end goes into sequences of descending powers of two, so nothing is padded.

Documents are encoded once, into files of identifiers in the shared scratch folder; the places are worked
out on lengths alone and meet the identifiers by blocks of documents. Blocks hold at most ``ROWS_A_BLOCK`` rows or
``WINDOWS_A_BLOCK`` windows, so neither a source nor a window is one task; block totals alone are
summed in one sorted pass.

Null texts are empty; an empty text has the end identifier alone. A null source is a queue of its own.
Rows that repeat are packed each. An empty table has no sequences. A very long document is spread
over as many windows as its queue's share asks for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aestudy.llm.tokens import encoder
from aestudy.sources.checkpoints import cut_lineage, scratch_path

#: A queue sends at least so many tokens at a time.
LEAST_SENT = 64
ROWS_A_BLOCK_BITS = 12
WINDOWS_A_BLOCK = 4096
#: Documents whose identifiers are cut together.
DOCS_AT_ONCE_BITS = 7
ROW_BITS = 40


def encode_rows(docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """row, doc_id, queue, n and the identifiers (little-endian, 16 or 32 bits) of all documents, in files."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    queue = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), queue.alias("queue"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    dtype = id_type(tokenizer, end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(tokenizer).encode
        end = np.array([] if end_id is None else [end_id], dtype=dtype).tobytes()
        row = TaskContext.get().partitionId() << ROW_BITS
        for batch in batches:
            found = [to_ids(text.as_py()).astype(dtype).tobytes() + end for text in batch.column(1).cast(pa.binary())]
            sizes = np.array([len(ids) for ids in found], dtype=np.int64) // np.dtype(dtype).itemsize
            numbers = np.arange(row, row + len(found), dtype=np.int64)
            row += len(found)
            yield pa.RecordBatch.from_arrays([pa.array(numbers), batch.column(0), batch.column(2), pa.array(sizes), pa.array(found, pa.binary())], names=["row", "doc_id", "queue", "n", "ids"])

    schema = f"row long, doc_id {kind}, queue string, n long, ids binary"
    folder = scratch_path(docs.sparkSession, "encoded")
    rows.mapInArrow(encode, schema).where("n > 0").write.parquet(folder)
    return docs.sparkSession.read.schema(schema).parquet(folder)


def id_type(tokenizer: str, end_id: int | None) -> str:
    size = encoder(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True)
    return "<u2" if max(size - 1, end_id or 0) < 1 << 16 else "<u4"


def queue_phases(totals: DataFrame, all_tokens: int, targets: dict[str | None, float] | None) -> DataFrame:
    """queue and its phases: from stream position ``t`` on, ``x`` tokens are earned and each token more earns ``rate``."""
    if targets is None:
        rate = F.col("total") / F.lit(float(all_tokens))
        return totals.select("queue", F.array(F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("x"), rate.alias("rate"))).alias("phases"))
    if not targets or min(targets.values()) <= 0:
        raise ValueError("targets are positive")
    weights = {"" if s is None else "=" + s: float(w) for s, w in targets.items()}
    left = {r["queue"]: float(r["total"]) for r in totals.where(F.col("queue").isin(list(weights))).collect()}
    phases: dict[str, list[tuple[float, float, float]]] = {q: [] for q in left}
    sent = dict.fromkeys(left, 0.0)
    size, t, active = dict(left), 0.0, set(left)
    while active:
        share = sum(weights[q] for q in active)
        rates = {q: weights[q] / share for q in active}
        dry = min(active, key=lambda q: (left[q] / rates[q], q))
        step = left[dry] / rates[dry]
        for q in active:
            phases[q].append((t, sent[q], rates[q]))
            sent[q] += rates[q] * step
            left[q] -= rates[q] * step
        t += step
        ended = {q for q in active if q == dry or left[q] <= 1e-9 * size[q]}
        active -= ended
    named = totals.sparkSession.createDataFrame([(q, p) for q, p in phases.items()], "queue string, phases array<struct<t: double, x: double, rate: double>>")
    rest = max(all_tokens - sum(size.values()), 1.0)
    rate = F.col("total") / F.lit(rest)
    others = totals.where(~F.col("queue").isin(list(weights)))
    return named.union(others.select("queue", F.array(F.struct(F.lit(t).alias("t"), F.lit(0.0).alias("x"), rate.alias("rate")))))


class Credit:
    """What one queue has earned, turn by turn, as numpy arithmetic on many turns or positions."""

    def __init__(self, phases: list[dict], every: int, late: int, most: int) -> None:
        self.t, self.x, self.rate = (np.array([p[field] for p in phases], dtype=np.float64) for field in ("t", "x", "rate"))
        self.every, self.late, self.most = every, late, most

    def earned(self, turn: np.ndarray) -> np.ndarray:
        """The end of what the queue may send in turns before ``turn``, counted from 0."""
        at = (turn * self.every - self.late) * float(self.most)
        now = np.maximum(np.searchsorted(self.t, at, side="right") - 1, 0)
        value = np.floor(self.x[now] + (at - self.t[now]) * self.rate[now])
        return np.where(turn <= 0, 0, np.maximum(value, 0)).astype(np.int64)

    def turn_of(self, position: np.ndarray) -> np.ndarray:
        """The turn in which the token at ``position`` of the queue is sent."""
        now = np.maximum(np.searchsorted(self.x, position, side="right") - 1, 0)
        t = self.t[now] + (position - self.x[now]) / self.rate[now]
        guess = np.maximum(np.floor((t / self.most + self.late) / self.every), 0).astype(np.int64)
        guess -= (guess > 0) & (position < self.earned(guess))
        return guess + (position >= self.earned(guess + 1))


def expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges from ``first`` to ``last``, both included: the range and the number of every element."""
    sizes = last - first + 1
    own = np.repeat(np.arange(len(sizes)), sizes)
    return own, first[own] + np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def sums_before(blocks: DataFrame, keys: list[str], block: str, value: str, name: str) -> DataFrame:
    """Per block the sum of ``value`` over the blocks before it with the same ``keys``."""
    order = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(*keys, block, F.coalesce(F.sum(value).over(order), F.lit(0)).alias(name))


def place_tokens(lengths: DataFrame, most: int, least: int, targets: dict[str | None, float] | None) -> DataFrame:
    """row, start, length, sequence_id and offset of every piece, from row, queue and n alone."""
    lengths = lengths.withColumn("block", F.shiftright("row", ROWS_A_BLOCK_BITS))
    blocks = cut_lineage(lengths.groupBy("queue", "block").agg(F.sum("n").alias("n")))
    all_tokens = blocks.agg(F.sum("n")).first()[0] or 0
    totals = blocks.groupBy("queue").agg(F.sum("n").alias("total"))
    queues = queue_phases(totals, all_tokens, targets)
    every = F.greatest(F.ceil(F.lit(float(least)) / (F.element_at("phases", 1)["rate"] * most)), F.lit(1)).cast("long")
    queues = queues.withColumn("every", every).withColumn("late", F.pmod(F.xxhash64("queue"), F.col("every")))

    within = Window.partitionBy("queue", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    before = sums_before(blocks, ["queue"], "block", "n", "before")
    rows = lengths.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0))).join(before, ["queue", "block"])
    rows = rows.select("row", "queue", "n", (F.col("before") + F.col("inside")).alias("begin")).join(queues, "queue")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The stretches that documents send in the turns of their queue."""
        for batch in batches:
            row, n, begin, turns, wait = (batch.column(i).to_numpy() for i in (0, 2, 3, 5, 6))
            names = batch.column(1).dictionary_encode()
            for k in range(len(names.dictionary)):
                own = np.flatnonzero(names.indices.to_numpy() == k)
                every, late = int(turns[own[0]]), int(wait[own[0]])
                credit = Credit(batch.column(4)[own[0]].as_py(), every, late, most)
                start, end = begin[own], begin[own] + n[own]
                doc, turn = expand(credit.turn_of(start), credit.turn_of(end - 1))
                x, x_end = np.maximum(start[doc], credit.earned(turn)), np.minimum(end[doc], credit.earned(turn + 1))
                some = x < x_end
                doc, turn, x, x_end = doc[some], turn[some], x[some], x_end[some]
                queue = pa.array([names.dictionary[k].as_py()] * len(doc), pa.string())
                columns = [pa.array(row[own][doc]), queue, pa.array(start[doc]), pa.array((turn + 1) * every - late - 1), pa.array(x), pa.array(x_end)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "queue", "begin", "window", "x", "x_end"])

    rows = rows.select("row", "queue", "n", "begin", "phases", "every", "late")
    sent = cut_lineage(rows.mapInArrow(send, "row long, queue string, begin long, window long, x long, x_end long"))

    # The place of a window's queue in the stream: after all earlier windows, and the queues before it in its own.
    groups = sent.groupBy("window", "queue").agg(F.sum(F.col("x_end") - F.col("x")).alias("n"), F.min("x").alias("first"))
    groups = groups.withColumn("block", F.floor(F.col("window") / WINDOWS_A_BLOCK))
    inside = Window.partitionBy("block").orderBy("window", "queue").rowsBetween(Window.unboundedPreceding, -1)
    stretches = sums_before(groups.groupBy("block").agg(F.sum("n").alias("n")), [], "block", "n", "before")
    groups = groups.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(stretches, "block")
    groups = groups.select("window", "queue", (F.col("before") + F.col("inside") - F.col("first")).alias("shift"))

    whole, rest = divmod(all_tokens, most)
    tail = [0]
    for bit in range(most.bit_length(), -1, -1):
        if rest >> bit & 1:
            tail.append(tail[-1] + (1 << bit))
    starts = np.array(tail, dtype=np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The stretches, cut where sequences end."""

        def sequence_of(place: np.ndarray) -> np.ndarray:
            return np.where(place < whole * most, place // most, whole + np.searchsorted(starts, place - whole * most, side="right") - 1)

        def sequence_start(sequence: np.ndarray) -> np.ndarray:
            return np.where(sequence <= whole, sequence * most, whole * most + starts[np.clip(sequence - whole, 0, len(starts) - 1)])

        for batch in batches:
            row, start, a, b = (column.to_numpy() for column in batch.columns)
            own, sequence = expand(sequence_of(a), sequence_of(b - 1))
            left, right = np.maximum(a[own], sequence_start(sequence)), np.minimum(b[own], sequence_start(sequence + 1))
            columns = [row[own], start[own] + left - a[own], right - left, sequence, left - sequence_start(sequence)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "start", "length", "sequence_id", "offset"])

    placed = sent.join(groups.hint("shuffle_hash"), ["window", "queue"]).select("row", (F.col("x") - F.col("begin")).alias("start"), (F.col("x") + F.col("shift")).alias("a"), (F.col("x_end") + F.col("shift")).alias("b"))
    cuts = placed.mapInArrow(cut, "row long, start long, length long, sequence_id long, offset long")
    return cuts


def pack_mixture(
    docs: DataFrame,
    tokenizer: str,
    end_id: int | None = 1,
    most: int = 2048,
    targets: dict[str | None, float] | None = None,
    least: int = LEAST_SENT,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, its ids."""
    if most < 1 or not 1 <= least <= most:
        raise ValueError("a sequence holds at least one token, and a queue sends between one and a sequence's")
    encoded = encode_rows(docs, tokenizer, end_id, id_col, text_col, source_col)
    pieces = place_tokens(encoded.select("row", "queue", "n"), most, least, targets)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    dtype = id_type(tokenizer, end_id)
    block = F.shiftright("row", DOCS_AT_ONCE_BITS)

    def cut(rows: pa.Table, places: pa.Table) -> pa.Table:
        """The pieces of some documents, their identifiers taken from the encoded rows."""
        by_row = np.argsort(rows.column("row").to_numpy())
        own = by_row[np.searchsorted(rows.column("row").to_numpy()[by_row], places.column("row").to_numpy())]
        wide = [np.frombuffer(ids, dtype).astype("<u4") for ids in rows.column("ids").to_pylist()]
        views = [memoryview(ids).cast("B") for ids in wide]
        start, length = places.column("start").to_numpy(), places.column("length").to_numpy()
        ranges = list(zip(own.tolist(), start.tolist(), (start + length).tolist()))
        crc = np.fromiter((zlib.crc32(views[i][4 * a : 4 * e]) for i, a, e in ranges), dtype=np.int64, count=len(ranges))
        taken = rows.select(["doc_id", "n"]).take(pa.array(own))
        columns = [taken.column(0), pa.array(start), pa.array(length), pa.array(crc), taken.column(1), places.column("sequence_id"), places.column("offset")]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            columns.append(pa.array([wide[i][a:e].astype(np.int32) for i, a, e in ranges], pa.list_(pa.int32())))
            names.append("ids")
        return pa.Table.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    rows = encoded.select(block.alias("block"), "row", "doc_id", "n", "ids").groupBy("block")
    return rows.cogroup(pieces.withColumn("of_block", block).groupBy("of_block")).applyInArrow(cut, schema)
