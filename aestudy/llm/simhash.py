"""Near duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint has a bit set where over half of the text's shingle hashes have it set; it has one or
more parts of 64 bits, each cut into segments. Two fingerprints that differ in at most ``radius``
bits differ in at most radius // segments bits of some segment. So each distinct fingerprint enters a
table and looks up small Hamming balls around each of its segments, and what it meets is linked if
the complete distance is at most ``radius``. With two segments of 32 bits and radius 3 that is 2 table
rows and 66 lookups for each fingerprint, and chance meetings stay rare up to billions of
fingerprints. Where the radius is too large for that (128 bits), ``reach`` bounds the difference in
the nearest segment, and a pair is missed with the chance that no segment is that near.

Equal fingerprints are one node, so copies are never paired. First every node is linked to the
smallest one that shares a segment with it, where they are near enough. Only nodes that are in
different components after that are compared over the balls, so a group of near copies does
not put out all its pairs. Links are joined into components by alternating star contractions, whose
number of rounds grows with the logarithm of the graph. Nodes of several parts are numbered by a
64-bit hash of them; two of them share a number with a chance of 2^-64.

With a ``similarity`` the fingerprints only nominate: they are taken over distinct shingles, each
distinct set of shingles is a node, and two nodes that meet within ``radius`` bits are linked where the
Jaccard similarity of their sets, computed from the texts, reaches it. Sets are compared by 64-bit
hashes of the shingles, in tiles of two blocks of nodes, to which a text is sent once. Sets whose sizes alone rule the similarity out do not meet.

Fingerprints nominate nearly all pairs of a large group whose members differ from a common text, most
of them below the similarity. So nodes that stars of a wider radius join to a crowd of more than ``CROWD``
are not paired with each other by fingerprints, but by what sets them apart from the crowd's common
shingles (``crowd_links``), which finds every pair of the crowd that reaches the similarity.

Words are maximal runs of characters other than space and tab to carriage return, with A-Z
lower-cased; shingles are words joined by a space, repeats included. A text of fewer words is one
shingle; a text without words has the fingerprint zero, which links like any other. Null texts are
empty; a null identifier gets the component of its fingerprint, null if no member has an identifier.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aestudy.llm.common import keyed_texts
from aestudy.sources import checkpoints

SEED = 42
#: Shingles whose bits are counted at once, a bound on memory for very long texts.
BLOCK = 1 << 16


def cut_lineage(df: DataFrame, few: bool = False) -> DataFrame:
    """``df`` from a checkpoint, without the shuffle files that made it: dozens of steps' would add up."""
    return checkpoints.cut_lineage(df, free=True, few=few)


def shingled(text: bytes, words: int) -> tuple[bytes, list[int], list[int]]:
    """The words of a UTF-8 text joined by a space, and where each shingle starts and ends in it."""
    parts = text.lower().split()
    joined = b" ".join(parts)
    if len(parts) <= words:
        return joined, [0] * bool(parts), [len(joined)] * bool(parts)
    ends = [e - 1 for e in accumulate(len(p) + 1 for p in parts)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    return joined, starts[: len(parts) - words + 1], ends[words - 1 :]


def fingerprint_of(text: bytes, words: int, lanes: int = 1) -> list[int]:
    """Unsigned 64-bit parts of the fingerprint of a UTF-8 text; part i votes over hashes of seed 42 + i."""
    joined, starts, ends = shingled(text, words)
    return votes(joined, starts, ends, lanes)


def votes(joined: bytes, starts: list[int], ends: list[int], lanes: int) -> list[int]:
    total = len(starts)
    counts = np.zeros((lanes, 64), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, BLOCK):
        shingles = [joined[a:e] for a, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])]
        for lane in range(lanes):
            hashes = np.array([digest(shingle, SEED + lane) for shingle in shingles], dtype="<u8")
            counts[lane] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > total, axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def shingle_hashes(joined: bytes, starts: list[int], ends: list[int]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:e], SEED) for a, e in zip(starts, ends)), dtype="<u8", count=len(starts))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    return np.unique(shingle_hashes(*shingled(text, words)))


def set_fingerprint(text: bytes, words: int, lanes: int) -> tuple[list[int], int, int]:
    """The fingerprint over distinct shingles, their number, and a signed 64-bit name of their set."""
    joined, starts, ends = shingled(text, words)
    own, first = np.unique(shingle_hashes(joined, starts, ends), return_index=True)
    name = int.from_bytes(hashlib.sha256(own.tobytes()).digest()[:8], "little", signed=True)
    return votes(joined, [starts[i] for i in first], [ends[i] for i in first], lanes), len(own), name


def similar(a: np.ndarray, b: np.ndarray, least: Fraction) -> bool:
    """Whether two sets of hashes have at least this Jaccard similarity."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * least.denominator >= (len(a) + len(b) - common) * least.numerator


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, lanes: int = 1, sets: bool = False) -> DataFrame:
    """doc_id, the fingerprint's parts as signed longs bits0, bits1, ... and the text's SHA-256, one row per row of ``docs``.

    ``sets``: over distinct shingles, with their number (size) and the name of their set (node).
    """
    if words < 1:
        raise ValueError("a shingle has at least one word")
    if lanes < 1:
        raise ValueError("a fingerprint has at least one part")
    rows = keyed_texts(docs, id_col, text_col)
    names = parts_of(lanes)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, digests, sizes, nodes = [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                whole = text.as_py()
                if sets:
                    own, size, node = set_fingerprint(whole, words, lanes)
                    sizes.append(size)
                    nodes.append(node)
                else:
                    own = fingerprint_of(whole, words, lanes)
                bits.append(own)
                digests.append(hashlib.sha256(whole).digest())
            signed = np.array(bits, dtype=np.uint64).reshape(-1, lanes).view(np.int64)
            columns = [pa.array(np.ascontiguousarray(signed[:, lane])) for lane in range(lanes)]
            columns += [pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64())] if sets else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests, pa.binary())], names=["doc_id", *names, "digest"])

    names += ["size", "node"] if sets else []
    longs = ", ".join(f"{name} long" for name in names)
    return rows.mapInArrow(mark, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {longs}, digest binary")


def parts_of(lanes: int) -> list[str]:
    return [f"bits{lane}" for lane in range(lanes)]


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """First bit and width of each segment of 64 bits."""
    edges = [round(64 * i / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def ball(width: int, radius: int) -> list[int]:
    """All masks of ``width`` bits with at most ``radius`` set."""
    return [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def entries(nodes: DataFrame, lanes: int, segments: int, reach: int, only: int | None = None) -> DataFrame:
    """The rows of ``nodes`` once per segment (``only``: of this part) and value within ``reach`` bits of their own, with columns segment and value."""
    rows, widths = [], {width for _, width in segment_bounds(segments)}
    for lane, name in enumerate(parts_of(lanes)):
        if only not in (None, lane):
            continue
        for s, (first, width) in enumerate(segment_bounds(segments)):
            value = F.shiftrightunsigned(F.col(name), first).bitwiseAND(F.lit((1 << width) - 1))
            rows.append(F.struct(F.lit(lane * segments + s).alias("segment"), F.lit(width).alias("width"), value.alias("value")))
    own = nodes.select("*", F.explode(F.array(*rows)).alias("entry"))
    if not reach:
        return own.select(*nodes.columns, "entry.segment", "entry.value")
    masks = F.coalesce(*(F.when(F.col("entry.width") == w, F.array(*(F.lit(m).cast("long") for m in ball(w, reach)))) for w in sorted(widths)))
    return own.select("*", F.explode(masks).alias("mask")).select(*nodes.columns, "entry.segment", F.col("entry.value").bitwiseXOR(F.col("mask")).alias("value"))


def distance(low: str, high: str, lanes: int) -> Column:
    """Bits in which the fingerprints of two struct columns or aliases differ."""
    return sum((F.bit_count(F.col(f"{low}.{name}").bitwiseXOR(F.col(f"{high}.{name}"))) for name in parts_of(lanes)), F.lit(0))


def star_links(nodes: DataFrame, radius: int, lanes: int, segments: int) -> DataFrame:
    """Pairs (low, high) of a node and the smallest node with an equal segment, where their complete distance is at most ``radius``.

    One pair per row at most, so a group of near copies is mostly one component before any two of its
    members are compared with each other.
    """
    rows = entries(nodes, lanes, segments, 0)
    heads = rows.groupBy("segment", "value").agg(F.min(F.struct("node", *parts_of(lanes))).alias("head"))
    near = (F.col("head.node") < F.col("row.node")) & (distance("head", "row", lanes) <= radius)
    return rows.alias("row").join(heads, ["segment", "value"]).where(near).select(F.col("head.node").alias("low"), F.col("row.node").alias("high")).distinct()


def links(nodes: DataFrame, radius: int = 3, segments: int = 2, lanes: int = 1, reach: int | None = None) -> DataFrame:
    """Pairs (low, high) of different roots with nodes (node, root, bits0, ...) that differ in at most ``radius`` bits.

    A pair is met if some segment of it differs in at most ``reach`` bits. Both sides enter balls, of
    half the reach each, so that a reach of two costs one bit on either side.
    """
    if reach is None:
        reach = radius // (segments * lanes)
    low, high = entries(nodes, lanes, segments, reach // 2).alias("low"), entries(nodes, lanes, segments, reach - reach // 2).alias("high")
    same = (F.col("low.segment") == F.col("high.segment")) & (F.col("low.value") == F.col("high.value"))
    met = low.join(high, same & (F.col("low.root") < F.col("high.root")) & (distance("low", "high", lanes) <= radius))
    return met.select(F.col("low.root").alias("low"), F.col("high.root").alias("high")).distinct()


def banded(nodes: DataFrame, similarity: float) -> DataFrame:
    """``nodes`` with a band of their size; sets of at least this similarity are in one band or in neighbouring ones."""
    step = -math.log(similarity) + 1e-9
    return nodes.withColumn("band", F.when(F.col("size") > 0, F.floor(F.log("size") / step)).otherwise(F.lit(-2)))


def star_candidates(nodes: DataFrame, radius: int, lanes: int, segments: int) -> DataFrame:
    """Pairs (low, high) as in ``star_links`` and their distance as bits, of nodes with (node, band, bits0, ...), the heads taken by band.

    A head meets the next band as well, so that a large group whose sizes lie in two bands is joined to one.
    """
    rows = entries(nodes, lanes, segments, 0)
    heads = rows.groupBy("segment", "value", "band").agg(F.min(F.struct("node", *parts_of(lanes))).alias("head"))
    heads = heads.withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    near = (F.col("head.node") != F.col("row.node")) & (distance("head", "row", lanes) <= radius)
    met = rows.alias("row").join(heads, ["segment", "value", "band"]).where(near)
    pair = F.least("head.node", "row.node").alias("low"), F.greatest("head.node", "row.node").alias("high")
    return met.select(*pair, distance("head", "row", lanes).alias("bits")).distinct()


def candidates(nodes: DataFrame, radius: int, segments: int, lanes: int, reach: int | None = None) -> DataFrame:
    """Pairs (low, high) of nodes (node, root, band, bits0, ...), checkpointed ones, with different roots, in one band or in neighbouring ones, that differ in at most ``radius`` bits and meet as in ``links``.

    Entries carry only the first ``SKETCH_PARTS`` parts, which rule out most chance meetings; what is left is
    compared by all parts. The segments of each part are met by a job of their own, so that the entries of one part
    at a time lie on disk.
    """
    if reach is None:
        reach = radius // (segments * lanes)
    tasks = tasks_of(nodes)
    carried = min(SKETCH_PARTS, lanes)
    wide = nodes.withColumn("band", F.explode(F.array(*(F.col("band") + F.lit(k) for k in (-1, 0, 1)))))
    place = F.shiftleft(F.col("band") * (segments * lanes) + F.col("segment"), 32).bitwiseXOR(F.col("value")) if segments > 1 else F.struct("band", "segment", "value")

    def keyed(rows: DataFrame, reach: int, lane: int) -> DataFrame:
        return entries(rows, lanes, segments, reach, lane).select("node", "root", *parts_of(carried), place.alias("place"))

    def met_by(lane: int) -> DataFrame:
        low, high = keyed(wide, reach // 2, lane).alias("low"), keyed(nodes, reach - reach // 2, lane).alias("high")
        same = F.col("low.place") == F.col("high.place")
        near = low.join(high, same & (F.col("low.root") < F.col("high.root")) & (distance("low", "high", carried) <= sketch_radius(radius, carried, lanes)))
        return cut_lineage(near.select(F.col("low.node").alias("low"), F.col("high.node").alias("high")).distinct())

    met = reduce(DataFrame.union, [met_by(lane).coalesce(tasks) for lane in range(lanes)]).distinct()
    if carried == lanes:
        return met
    sides = [nodes.select(F.col("node").alias(side), F.struct(*parts_of(lanes)).alias(f"{side}_bits")) for side in ("low", "high")]
    whole = met.join(sides[0], "low").join(sides[1], "high")
    return whole.where(distance("low_bits", "high_bits", lanes) <= radius).select("low", "high")


#: Parts of a fingerprint that entries carry.
SKETCH_PARTS = 2


def sketch_radius(radius: int, carried: int, lanes: int) -> int:
    """Bits that ``carried`` of ``lanes`` parts may differ in: their share of the radius and 3.25 standard deviations more."""
    share = radius * carried / lanes
    return radius if carried == lanes else min(radius, round(share + 3.25 * math.sqrt(share * (1 - radius / (64 * lanes)))))


#: Bytes of texts that one side of a tile holds, and blocks of nodes at least, so that there are tiles for many tasks.
TILE_BYTES = 24 << 20
FEWEST_BLOCKS = 6


def texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """node and the text of its first row, of all ``wanted`` nodes."""
    digests = nodes.join(wanted, "node").select("node", F.col("first.digest").alias("digest"))
    own = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    return own.join(digests, "digest").dropDuplicates(["node"]).select("node", "text")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, words: int, similarity: float) -> DataFrame:
    """The pairs (low, high), checkpointed ones, of nodes (node, first) whose texts have at least the Jaccard similarity.

    Nodes are dealt into blocks by hash, and a pair belongs to the tile of its two blocks. A text is sent to
    a tile once, however many pairs it has there, and a tile holds the sets of two blocks at most.
    """
    least = Fraction(str(similarity))
    met = pairs.select(F.col("low").alias("node")).union(pairs.select(F.col("high").alias("node"))).distinct()
    texts = cut_lineage(texts_of(met, nodes, docs, text_col))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(FEWEST_BLOCKS, -(-size // TILE_BYTES))

    def block(name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(blocks))

    tiled = pairs.withColumn("tile", F.least(block("low"), block("high")) * blocks + F.greatest(block("low"), block("high")))
    users = tiled.select("tile", F.col("low").alias("node")).union(tiled.select("tile", F.col("high").alias("node"))).distinct()
    sent = users.join(texts, "node").select(F.col("tile").alias("to_tile"), "node", "text")

    def compare(own_pairs: pa.Table, own_texts: pa.Table) -> pa.Table:
        sets = {node: shingle_set(text.as_py().encode(), words) for node, text in zip(own_texts.column("node").to_pylist(), own_texts.column("text"))}
        low, high = own_pairs.column("low").to_pylist(), own_pairs.column("high").to_pylist()
        keep = [similar(sets[a], sets[b], least) for a, b in zip(low, high)]
        return own_pairs.select(["low", "high"]).filter(pa.array(keep, pa.bool_()))

    return tiled.groupBy("tile").cogroup(sent.groupBy("to_tile")).applyInArrow(compare, "low long, high long")


#: Edges that a task of a contraction may have before there are two, as rounds over few edges are many.
EDGES_A_TASK = 1 << 17
#: Nodes that a task may have, in steps that read or write them by row. The driver's memory grows with the tasks of all steps.
NODES_A_TASK = 1 << 14
#: Tasks of such steps at least.
FEWEST_TASKS = 6


def tasks_of(nodes: DataFrame) -> int:
    """Partitions for rows of these nodes, checkpointed ones, whatever the number of partitions of shuffles."""
    return max(FEWEST_TASKS, -(-nodes.count() // NODES_A_TASK))


def contract(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (low, high): root is the smallest node reachable.

    Large-star and small-star rounds alternate until nothing changes; minima are pre-aggregated,
    so that a node with very many neighbours needs no task of its own. A round has as many tasks as its
    edges ask for, whatever the number of partitions of shuffles; while they ask for one, nothing is shuffled.
    """
    edges = cut_lineage(edges.select(F.greatest("low", "high").alias("u"), F.least("low", "high").alias("v")))
    count, seen = edges.count(), None
    while True:
        tasks = -(-count // EDGES_A_TASK) or 1
        edges = edges.coalesce(tasks)
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        edges = cut_lineage(small.union(least.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks), few=tasks == 1)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        count, seen = now[0], now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


#: Nodes that a group joined by nominations may have for its pairs to be met by fingerprints.
CROWD = 64
#: Classes of a crowd's members by how far they stand apart.
CLASSES = 16


def crowd_radius(radius: int, lanes: int) -> int:
    """Bits within which stars join a crowd: half the radius more, where that stays five deviations from unrelated sets.

    Members of a large group who stand too far from the heads to be linked to them would else meet most of the crowd.
    """
    return max(radius, min(radius * 3 // 2, int(32 * lanes - 20 * math.sqrt(lanes))))


def crowds_of(met: DataFrame) -> DataFrame:
    """node and crowd, the smallest node of its group, of the nodes that the pairs (low, high) join to more than ``CROWD``."""
    grouped = contract(met)
    large = grouped.groupBy("root").agg(F.count("*").alias("members")).where(F.col("members") > CROWD)
    return grouped.join(large, "root").select("node", F.col("root").alias("crowd"))


def crowd_members(crowded: DataFrame, texts: DataFrame, words: int, tasks: int) -> DataFrame:
    """node, crowd, root of ``crowded``, the size of the node's set, and as ``apart`` the hashes that either it or the crowd's common set has.

    The common set has what over half of the members have, so it is at most twice their mean size.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py().encode(), words).view(np.int64).tolist() for text in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.list_(pa.int64()))], names=["node", "crowd", "root", "hashes"])

    own = crowded.join(texts, "node").select("node", "crowd", "root", "text")
    members = cut_lineage(own.mapInArrow(hashed, "node long, crowd long, root long, hashes array<long>")).coalesce(tasks)
    count = members.groupBy("crowd").agg(F.count("*").alias("members"))
    held = members.select("crowd", F.explode("hashes").alias("h")).groupBy("crowd", "h").agg(F.count("*").alias("n"))
    common = held.join(count, "crowd").where(F.col("n") * 2 > F.col("members")).groupBy("crowd").agg(F.collect_list("h").alias("common"))
    both = members.join(common, "crowd", "left").withColumn("common", F.coalesce("common", F.array().cast("array<long>")))
    apart = F.concat(F.array_except("hashes", "common"), F.array_except("common", "hashes"))
    return both.select("node", "crowd", "root", F.size("hashes").alias("size"), apart.alias("apart"))


def crowd_links(crowded: DataFrame, texts: DataFrame, words: int, similarity: float, tasks: int = FEWEST_TASKS) -> tuple[DataFrame, DataFrame]:
    """Pairs (low, high) within crowds, of nodes (node, crowd, root): sure ones, and ones to be verified.

    The sets A and B of two members stand a and b hashes apart from the common set, and c of these hashes are the
    same, so they differ in a + b - 2c. Their similarity s is reached if that is at most (1 - s) / (1 + s) times
    |A| + |B|, so a member's excess is a - |A| (1 - s) / (1 + s), and a pair needs c of half the sum of both excesses.
    Where that is not above 0, the pair is sure, and both are sure with the crowd's member of least excess: they are its
    core and are linked to it alone. Any other pair shares one of the rarest hashes of each, all but the last c - 1
    in order of their number in the crowd. How many that are is told for each class of partners, so hashes that many
    members stand apart by are seldom among them. Core members are not met with each other, nor those of one root. Members are read by ``tasks`` tasks at most.
    """
    least = Fraction(str(similarity))
    up, down = least.denominator + least.numerator, least.denominator - least.numerator
    members = crowd_members(crowded, texts, words, tasks).withColumn("excess", F.size("apart").cast("long") * up - F.col("size") * down)
    members = cut_lineage(members).coalesce(tasks)
    spread = members.groupBy("crowd").agg(F.min(F.struct("excess", "node")).alias("hub"), F.max("excess").alias("most"))
    width = F.floor((F.col("most") - F.col("hub.excess")) / CLASSES) + 1
    placed = members.join(spread.select("crowd", "hub", width.alias("width")), "crowd")
    core = F.col("excess") + F.col("hub.excess") <= 0
    placed = placed.withColumn("core", core).withColumn("class", F.floor((F.col("excess") - F.col("hub.excess")) / F.col("width")))
    sure = placed.where("core AND node <> hub.node").select(F.least("node", "hub.node").alias("low"), F.greatest("node", "hub.node").alias("high"))

    kinds = placed.groupBy("crowd", "core", "class").agg(F.min("excess").alias("least"), F.max(F.size("apart")).alias("longest"))
    kinds = kinds.groupBy("crowd").agg(F.collect_list(F.struct("core", "class", "least", "longest")).alias("kinds"))
    apart = members.select("crowd", "node", F.explode("apart").alias("h"))
    shared = apart.groupBy("crowd", "h").agg(F.count("*").alias("n")).where("n > 1")
    shared = apart.join(shared, ["crowd", "h"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("shared"))
    ranked = cut_lineage(placed.drop("apart", "size", "hub", "width").join(shared, "node").join(kinds, "crowd")).coalesce(tasks)

    own = ranked.select("*", F.explode("kinds").alias("other")).where("NOT (core AND other.core)")
    need = F.greatest(F.lit(1), F.ceil((F.col("excess") + F.col("other.least")) / (2 * up)))
    own = own.withColumn("need", need).where(F.col("need") <= F.col("other.longest"))
    # The hash at place i has size(shared) - i hashes from it on, of which a pair that meets there first needs all it shares.
    own = own.select("*", F.posexplode(F.expr("slice(shared, 1, CAST(greatest(0, size(shared) - need + 1) AS int))")).alias("i", "rare"))
    mine, theirs = F.struct("core", "class"), F.struct("other.core", "other.class")
    own = own.select(
        F.xxhash64("crowd", "rare.h", F.least(mine, theirs), F.greatest(mine, theirs)).alias("place"),
        mine.alias("mine"),
        theirs.alias("theirs"),
        "node",
        "root",
        "excess",
        (F.size("shared") - F.col("i")).alias("room"),
    )
    a, b = own.alias("a"), own.alias("b")
    turned = (F.col("a.mine") == F.col("b.theirs")) & (F.col("a.theirs") == F.col("b.mine"))
    shares = F.ceil((F.col("a.excess") + F.col("b.excess")) / (2 * up))
    open_pair = (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root")) & (shares > 0)
    met = a.join(b, (F.col("a.place") == F.col("b.place")) & turned & open_pair & (shares <= F.least("a.room", "b.room")))
    return sure, met.select(F.col("a.node").alias("low"), F.col("b.node").alias("high")).distinct()


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    radius: int = 3,
    segments: int = 2,
    lanes: int = 1,
    reach: int | None = None,
    similarity: float | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits a part), component_id, kept, text_sha256.

    component_id is the smallest identifier reachable over links, the row's own included; the row that
    has it is kept, of several such rows those with the smallest text digest. Fingerprints have
    ``lanes`` parts of 64 bits, each of ``segments`` segments. Without ``reach`` every pair within
    ``radius`` bits is linked; with it, those with a segment that differs in at most ``reach`` bits.
    With ``similarity``, of these pairs those whose distinct shingles have that Jaccard similarity, and
    in crowds all that have it.
    """
    if similarity is not None and not 0 < similarity < 1:
        raise ValueError("a similarity is between 0 and 1")
    parts = parts_of(lanes)
    marked = fingerprints(docs, id_col, text_col, words, lanes, sets=similarity is not None)
    if similarity is None:
        marked = marked.withColumn("node", F.col("bits0") if lanes == 1 else F.xxhash64(*parts))
    marked = cut_lineage(marked)
    own = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "digest")
    sizes = [] if similarity is None else ["size"]
    nodes = cut_lineage(marked.groupBy("node", *parts, *sizes).agg(F.min(own).alias("first")))
    tasks = tasks_of(nodes)
    nodes = nodes.coalesce(tasks)

    def rooted(rows: DataFrame, edges: DataFrame) -> DataFrame:
        roots = contract(edges).withColumnRenamed("root", "lower")
        joined = rows.join(roots, rows["root"] == roots["node"], "left")
        return joined.select(*(rows[c] for c in rows.columns if c != "root"), F.coalesce("lower", rows["root"]).alias("root"))

    if similarity is None:
        bits = nodes.select("node", *parts)
        stars = star_links(bits, radius, lanes, segments)
    else:
        bits = cut_lineage(banded(nodes.select("node", "size", *parts), similarity))
        around = cut_lineage(star_candidates(bits, crowd_radius(radius, lanes), lanes, segments)).coalesce(tasks)
        nominated = around.where(F.col("bits") <= radius).select("low", "high")
        stars = verified(nominated, nodes, docs, text_col, words, similarity)
    starred = cut_lineage(rooted(bits.withColumn("root", F.col("node")), stars)).coalesce(tasks)
    if similarity is None:
        edges = links(starred, radius, segments, lanes, reach)
    else:
        crowds = cut_lineage(crowds_of(around)).coalesce(tasks)
        # Nodes of one root are in one crowd, so a crowd's number can stand for its roots.
        apart = starred.join(crowds, "node", "left").withColumn("root", F.coalesce("crowd", "root")).drop("crowd")
        apart = cut_lineage(apart).coalesce(tasks)
        met = candidates(apart, radius, segments, lanes, reach)
        sure = None
        if not crowds.isEmpty():
            texts = texts_of(crowds.select("node"), nodes, docs, text_col)
            sure, close = crowd_links(crowds.join(starred.select("node", "root"), "node"), texts, words, similarity, tasks)
            met = met.union(close)
        pairs = verified(cut_lineage(met).coalesce(lanes * tasks), nodes, docs, text_col, words, similarity)
        pairs = pairs if sure is None else pairs.union(sure)
        of = [starred.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")) for side in ("low", "high")]
        edges = pairs.join(of[0], "low").join(of[1], "high").select(F.col("low_root").alias("low"), F.col("high_root").alias("high")).distinct()
    grouped = rooted(starred, edges).select("node", *parts, "root")
    firsts = nodes.join(grouped, ["node", *parts])
    smallest = firsts.groupBy("root").agg(F.min("first").alias("stays"))
    labels = firsts.join(smallest, "root").select("node", *parts, "stays")
    return marked.join(labels, ["node", *parts]).select(
        "doc_id",
        F.lower(F.concat(*(F.lpad(F.hex(p), 16, "0") for p in parts))).alias("fingerprint"),
        F.col("stays.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("digest") == F.col("stays.digest"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
