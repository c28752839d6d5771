"""Packing of token pieces into sequences by length patterns and non-negative least squares.

Documents are cut into pieces of at most ``most`` tokens (the first one takes the remainder). The
histogram of piece lengths has ``most`` entries, whatever the corpus, so it is planned on the driver:
all patterns of one to three lengths that fill a sequence exactly are the columns of a least-squares
fit whose non-negative repeat counts should use up the histogram; counts (or a share of them) are
rounded to what is there, and the pieces left over are packed best-fit decreasing, counted by length. Tasks then place
the pieces: a piece's rank among those of its length (ranks are counted in blocks, so that a length
that a third of all pieces share is never in one task) leads to its pattern, repeat and offset.

Null texts are empty; an empty text is one piece with the end identifier. Rows that repeat are packed
each. An empty table has no sequences.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aestudy.llm.common import keyed_texts
from aestudy.llm.tokens import encoder
from aestudy.sources.checkpoints import cut_lineage

#: Rows of one length that are ranked in one block.
ROWS_PER_BLOCK = 100_000
STEPS = 1500
SHARES = (1.0, 0.9, 0.7, 0.5, 0.25, 0.0)


def cut_pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int | None = 2,
    most: int = 1024,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    if most < 1:
        raise ValueError("a sequence holds at least one token")
    rows = keyed_texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        end = np.array([] if end_id is None else [end_id], dtype="<u4")
        for batch in batches:
            source, piece, start, length, crc, pieces = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                ids = np.concatenate([encode(text.as_py()), end]).astype("<u4", copy=False)
                first = (len(ids) - 1) % most + 1 if len(ids) else 0
                edges = [0, *range(first, len(ids) + 1, most)] if len(ids) else []
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    source.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    if with_ids:
                        pieces.append(ids[a:b].astype(np.int32))
            columns = [batch.column(0).take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(pieces, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(cut, schema)


def full_patterns(lengths: np.ndarray, most: int) -> np.ndarray:
    """All multisets of one to three of the lengths that add up to ``most``; rows padded with 0."""
    there = np.zeros(most + 1, dtype=bool)
    there[lengths] = True
    found = [(most, 0, 0)] if there[most] else []
    for a in lengths[::-1]:
        rest = most - a
        if rest < 1 or 3 * a < most:
            continue
        if rest <= a and there[rest]:
            found.append((a, rest, 0))
        b = lengths[(lengths <= min(a, rest - 1)) & (2 * lengths >= rest)]
        b = b[there[rest - b]]
        found += [(a, x, rest - x) for x in b]
    return np.array(found, dtype=np.int64).reshape(-1, 3)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative repeat counts whose use of each length is nearest to the histogram.

    Lengths are weighted by themselves: a long piece that is left over costs more than a short one.
    Solved by accelerated projected gradients; the step comes from the pattern with most company.
    """
    most = len(histogram) - 1
    weight = (np.arange(most + 1) / most) ** 2
    weight[0] = 0.0
    used = np.bincount(patterns.ravel(), minlength=most + 1)
    step = 1.0 / (3.0 * (weight * used).max())
    x = np.zeros(len(patterns))
    ahead, t = x, 1.0
    flat, rows = patterns.ravel(), np.repeat(np.arange(len(patterns)), patterns.shape[1])
    for _ in range(STEPS):
        load = np.bincount(flat, weights=ahead[rows], minlength=most + 1)
        gradient = (weight * (load - histogram))[patterns].sum(axis=1)
        new = np.maximum(ahead - step * gradient, 0.0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def rounded_plan(patterns: np.ndarray, repeats: np.ndarray, histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Rounded repeats of the patterns, as far as the pieces go, and sequences of what they leave over."""
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    for j in np.argsort(-repeats, kind="stable"):
        wanted = int(round(repeats[j]))
        if not wanted:
            break
        own = [int(v) for v in patterns[j] if v]
        count = min(wanted, min(left[v] // own.count(v) for v in own))
        if count > 0:
            for v in own:
                left[v] -= count
            plan.append((tuple(own), int(count)))
    return plan + pack_left_over(left)


def plan_patterns(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of all sequences for ``histogram``, whose entry i counts the pieces of length i.

    The fit may spend short pieces that longer ones left over would need. So its repeat counts are also
    tried at the shares ``SHARES``, down to none, and the plan with the fewest sequences is taken.
    """
    lengths = np.flatnonzero(histogram)
    patterns = full_patterns(lengths, len(histogram) - 1) if len(lengths) else np.zeros((0, 3), dtype=np.int64)
    repeats = fit_repeats(patterns, histogram) if len(patterns) else np.zeros(0)
    plans = [rounded_plan(patterns, share * repeats, histogram) for share in SHARES]
    return min(plans, key=lambda plan: sum(count for _, count in plan))


def pack_left_over(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: all pieces of a length are placed together."""
    most = len(left) - 1
    open_bins: dict[int, list[list]] = defaultdict(list)  # room -> [lengths, count]
    for length in range(most, 0, -1):
        n = int(left[length])
        while n:
            room = next((r for r in range(length, most + 1) if open_bins.get(r)), None)
            if room is None:
                fit = most // length
                full, rest = divmod(n, fit)
                if full:
                    open_bins[most - fit * length].append([(length,) * fit, full])
                if rest:
                    open_bins[most - rest * length].append([(length,) * rest, 1])
                n = 0
                continue
            entry = open_bins[room][-1]
            fit = room // length
            full = min(entry[1], n // fit)
            if full:
                open_bins[room - fit * length].append([entry[0] + (length,) * fit, full])
                entry[1] -= full
                n -= full * fit
            elif n:
                open_bins[room - n * length].append([entry[0] + (length,) * n, 1])
                entry[1] -= 1
                n = 0
            if not entry[1]:
                open_bins[room].remove(entry)
    return [(own, count) for bins in open_bins.values() for own, count in bins]


def slots(plan: list[tuple[tuple[int, ...], int]], most: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: runs of ranks with their first sequence and offset.

    ``first`` is sorted and numbers the pieces of all lengths one after another; ``base`` holds each
    length's first number.
    """
    runs = []
    sequence = 0
    for own, count in plan:
        offset = 0
        for length in own:
            runs.append((length, sequence, offset, count))
            offset += length
        sequence += count
    runs.sort()
    table = np.array(runs, dtype=np.int64).reshape(-1, 4)
    first = np.concatenate([[0], np.cumsum(table[:, 3])])[:-1]
    total = np.bincount(table[:, 0], weights=table[:, 3], minlength=most + 1).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(total)])[:-1]
    return {"first": first, "sequence": table[:, 1], "offset": table[:, 2], "base": base}


def pack(pieces: DataFrame, most: int = 1024) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ... as from ``cut_pieces``) with sequence_id and offset."""
    pieces = cut_lineage(pieces)
    counts = pieces.groupBy("length").count().collect()
    histogram = np.zeros(most + 1, dtype=np.int64)
    for row in counts:
        if not 0 < row["length"] <= most:
            raise ValueError(f"a piece has {row['length']} tokens, a sequence at most {most}")
        histogram[row["length"]] = row["count"]
    places = slots(plan_patterns(histogram), most)

    blocks = int(histogram.max(initial=0) // ROWS_PER_BLOCK) + 16
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "block").count()
    bases = sizes.select("length", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "block").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("rank", F.row_number().over(order)).join(bases, ["length", "block"])
    ranked = ranked.withColumn("rank", F.col("rank") - 1 + F.col("before"))

    names = pieces.columns
    at = names.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = places["base"][batch.column(at).to_numpy()] + batch.column(len(names)).to_numpy()
            run = np.searchsorted(places["first"], number, side="right") - 1
            sequence = places["sequence"][run] + number - places["first"][run]
            columns = [*batch.columns[:-1], pa.array(sequence), pa.array(places["offset"][run])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    kept = ranked.select(*names, "rank")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return kept.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token sequences: sequence_id, ids and the documents' lengths in order.

    A sequence has at most as many pieces as tokens, so each group is bounded.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.length").alias("lengths"))
