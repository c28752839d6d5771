"""Spelling variants: words one edit apart, found by walking a trie that is a distributed table.

Two words one edit apart are the same before the middle or behind it. So there are two tries, of the
words and of the words written backwards, and an edit is made only at or behind the middle, where a trie's
nodes have few edges: the walk forwards finds neighbours with the same first half, the walk backwards
those with another one. A trie has one row per node: its prefix and its
edges (a letter, the letters that follow it, whether a word ends behind it), never more than the
alphabet has letters; nodes before the middle of all their words are left out. The frontier holds states (word, position, node, edit).
At each level the states that stand at nodes of that depth are joined to these nodes and take one edge:

* a state without an edit stands at its word's own prefix; with an edge other than the word's next
  letter it becomes a replacement (the letter is passed over) or an insertion (it is not);
* a state with an edit takes the edge of the word's next letter.

An edge's following letters drop a state that could not go on. A state that has used up its word where a
word ends is a neighbour. Deletions are insertions seen from the other word, so they are turned round at
the end. An edge equal to the next letter is never inserted, so each walk finds a neighbour once.

Nodes of the first two depths are at most 1 + the alphabet's letters in each trie and are broadcast; below, a join
by node is left to adaptive execution, which splits a node that many words share. Every level is
written to the shared scratch folder and read on from there. Words longer than ``LEVELS`` would need a level a letter; they meet by the hashes of
what deleting one letter leaves, one row a letter, and met pairs are checked with the edit distance.

A null or empty text has no words, a null identifier is written as nothing before the colon, and rows
that repeat are counted each. An empty table gives an empty result. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aestudy.llm.common import keyed_texts
from aestudy.sources.checkpoints import cut_lineage, scratch_path

#: Letters of words: A-Z, a-z and U+00C0 to U+00FF, the alphabet that bounds the edges of a node.
LETTER_RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of more code points are met by hashes instead of level by level.
LEVELS = 32
#: Nodes down to this depth are few enough, whatever the words, to be sent to every task.
BROADCAST_DEPTH = 1
HASH_PRIME, HASH_BASE = (1 << 61) - 1, 1_000_003
ROWS_A_BATCH = 50_000


def count_words(docs: DataFrame, drop_one_in: int | None = 97, least_length: int = 5, least_count: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n: the runs of letters of all texts, lower-cased in A-Z, that are long and frequent enough.

    With ``drop_one_in``, an occurrence whose crc32 of ``<doc_id>:<run>`` it divides loses one letter.
    """
    texts = keyed_texts(docs, id_col, text_col)
    runs = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({LETTER_RUN})"), F.lit(1))).alias("run"))
    word = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER))
    words = runs.select("doc_id", word.alias("word"))
    if drop_one_in:
        owner = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
        words = words.withColumn("h", F.crc32(F.concat(owner, F.lit(":"), F.col("word")).cast("binary")))
        at = "CAST(h % length(word) AS int)"
        cut = F.expr(f"concat(substring(word, 1, {at}), substring(word, {at} + 2))")
        words = words.select(F.when(F.col("h") % drop_one_in == 0, cut).otherwise(F.col("word")).alias("word"))
    counted = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def both_ways(words: DataFrame) -> DataFrame:
    """word, back and start: every word forwards and backwards, and the least place of an edit in it."""
    half = F.expr("length(word) div 2")
    backwards = words.select(F.reverse("word").alias("word"), F.lit(True).alias("back"), (F.length("word") - half).alias("start"))
    return words.select("word", F.lit(False).alias("back"), half.alias("start")).union(backwards)


def trie_nodes(ways: DataFrame) -> DataFrame:
    """The tries of ``ways`` where states can stand, one row per inner node: depth, back, node, edges (letter, following letters, ends).

    A word is a neighbour of one a letter shorter, whose edits start at the same place or one before its own.
    """
    least = F.when(F.col("back"), F.expr("length(word) div 2")).otherwise(F.expr("greatest(0, length(word) - 1) div 2"))
    steps = ways.select("word", "back", F.explode(F.sequence(least.cast("int"), F.length("word"))).alias("depth"))
    steps = steps.select("depth", "back", F.expr("substring(word, 1, depth)").alias("node"), F.expr("substring(word, depth + 1, 1)").alias("letter"))
    letters = F.collect_set(F.when(F.col("letter") != "", F.col("letter")))
    nodes = steps.groupBy("depth", "back", "node").agg(F.concat_ws("", F.sort_array(letters)).alias("following"), F.max(F.col("letter") == "").alias("ends"))
    up = nodes.where("depth > 0").select(
        (F.col("depth") - 1).alias("depth"),
        "back",
        F.expr("substring(node, 1, depth - 1)").alias("node"),
        F.struct(F.expr("substring(node, depth, 1)").alias("letter"), "following", "ends").alias("edge"),
    )
    return up.groupBy("depth", "back", "node").agg(F.collect_list("edge").alias("edges"))


def walk_trie(words: DataFrame, longest: int) -> DataFrame:
    """word, near, edit of all words one replaced (1) or inserted (2) letter away; ``words`` are checkpointed."""
    spark = words.sparkSession
    folder = scratch_path(spark, "trie")
    ways = both_ways(words)
    trie_nodes(ways).write.partitionBy("depth").parquet(folder)
    nodes = spark.read.schema("back boolean, node string, edges array<struct<letter: string, following: string, ends: boolean>>, depth int").parquet(folder)
    levels = scratch_path(spark, "trie-levels")
    states_schema = "word string, back boolean, pos int, node string, edit int"
    frontier = None
    for depth in range(longest + 1):
        states = ways.where((F.col("start") <= depth) & (F.length("word") >= depth)).select("word", "back", F.lit(depth).alias("pos"), F.expr(f"substring(word, 1, {depth})").alias("node"), F.lit(0).alias("edit"))
        if frontier is not None:
            states = states.union(frontier)
        level = nodes.where(F.col("depth") == depth).select("back", "node", "edges")
        here = states.join(F.broadcast(level) if depth <= BROADCAST_DEPTH else level, ["back", "node"])
        ahead = [F.expr(f"substring(word, pos + {k}, 1)").alias(f"next{k}") for k in (1, 2)]
        edges = here.select("word", "back", "pos", "edit", "node", *ahead, F.inline("edges"))
        fresh, other = F.col("edit") == 0, F.col("letter") != F.col("next1")
        # What is left of the word has to end here, or to go on with a letter that follows the edge.
        fits_next = F.when(F.col("next1") == "", F.col("ends")).otherwise(F.expr("instr(following, next1) > 0"))
        fits_over = F.when(F.col("next2") == "", F.col("ends")).otherwise(F.expr("instr(following, next2) > 0"))
        replaces = fresh & other & (F.col("next1") != "") & fits_over
        inserts = fresh & other & fits_next
        passes = ~fresh & ~other & fits_over
        taken = edges.where(replaces | inserts | passes)
        over, stay = F.struct((F.col("pos") + 1).alias("pos"), F.when(fresh, 1).otherwise(F.col("edit")).alias("edit")), F.struct("pos", F.lit(2).alias("edit"))
        to = F.when(replaces & inserts, F.array(over, stay)).when(inserts, F.array(stay)).otherwise(F.array(over))
        moved = taken.select("word", "back", F.concat("node", "letter").alias("node"), F.inline(to))
        moved.select("word", "back", "pos", "node", "edit").write.parquet(f"{levels}/level={depth}")
        frontier = spark.read.schema(states_schema).parquet(f"{levels}/level={depth}").where(F.col("pos") < F.length("word"))
    ended = spark.read.schema(f"{states_schema}, level int").parquet(levels).where(F.col("pos") == F.length("word"))
    word, near = (F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c)) for c in ("word", "node"))
    found = ended.select(word.alias("word"), near.alias("near"), "edit", "back")
    return found.where("NOT back OR left(word, length(word) div 2) <> left(near, length(word) div 2)").drop("back")


def deletion_hashes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For every word: its own hash (place -1), and the hash of what is left without the letter at each place."""
    rows: list[tuple[str, int, int, int]] = []
    for frame in frames:
        for key, word in zip(frame["key"], frame["word"]):
            codes = [ord(c) for c in word]
            tail, tails, power, powers = 0, [0], 1, [1]
            for c in reversed(codes):
                tail = (tail + c * power) % HASH_PRIME
                power = power * HASH_BASE % HASH_PRIME
                tails.append(tail)
                powers.append(power)
            rows.append((key, -1, len(codes), tail))
            head = 0
            for i, c in enumerate(codes):
                after = len(codes) - 1 - i
                rows.append((key, i, len(codes), (head * powers[after] + tails[after]) % HASH_PRIME))
                head = (head * HASH_BASE + c) % HASH_PRIME
                if len(rows) >= ROWS_A_BATCH:
                    yield pd.DataFrame(rows, columns=["key", "place", "size", "h"])
                    rows = []
    if rows:
        yield pd.DataFrame(rows, columns=["key", "place", "size", "h"])


def meet_long_words(words: DataFrame, longer_than: int) -> DataFrame:
    """word, near of words one edit apart of which one at least has more than ``longer_than`` code points.

    Words share a hash when one without a letter is the other, or both without the letter at the same place
    are the same; as many words share the latter as the alphabet has letters, so pairs are bounded.
    """
    keyed = words.where(F.length("word") >= longer_than).select(F.sha2(F.col("word").cast("binary"), 256).alias("key"), "word")
    hashes = cut_lineage(keyed.mapInPandas(deletion_hashes, "key string, place int, size int, h long"))
    cut = hashes.where("place >= 0")
    whole = hashes.where("place < 0").select(F.col("key").alias("other"), F.col("size").alias("left_size"), "h")
    deleted = cut.withColumn("left_size", F.col("size") - 1).join(whole, ["left_size", "h"]).select("key", "other")
    other = cut.select(F.col("key").alias("other"), "size", "place", "h")
    replaced = cut.join(other, ["size", "place", "h"]).where("key <> other").select("key", "other")
    met = deleted.union(deleted.select(F.col("other").alias("key"), F.col("key").alias("other"))).union(replaced).distinct()
    pairs = met.join(keyed, "key").join(keyed.select(F.col("key").alias("other"), F.col("word").alias("near")), "other")
    return pairs.where((F.greatest(F.length("word"), F.length("near")) > longer_than) & (F.levenshtein("word", "near", 1) == 1)).select("word", "near")


def near_words(words: DataFrame, levels: int = LEVELS) -> DataFrame:
    """word and near: all ordered pairs of different words exactly one code point's edit apart."""
    words = cut_lineage(words.select("word"))
    short = words.where(F.length("word") <= levels)
    longest, has_long = words.agg(F.max(F.when(F.length("word") <= levels, F.length("word"))), F.count(F.when(F.length("word") > levels, 1))).first()
    out = words.select("word", F.col("word").alias("near")).where("false")
    if longest is not None:
        walked = walk_trie(short, longest)
        out = out.union(walked.select("word", "near")).union(walked.where("edit = 2").select(F.col("near").alias("word"), F.col("word").alias("near")))
    if has_long:
        out = out.union(meet_long_words(words, levels))
    return out


def roots_of(forms: DataFrame) -> DataFrame:
    """word and root: where following word -> form ends. Every round doubles the steps taken."""
    reached = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = cut_lineage(reached.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        reached = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return reached


def group_variants(words: DataFrame, ratio: int = 2, levels: int = LEVELS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of ``words`` (word, n).

    A word's form is its most frequent near word (of equal ones the smallest), if that has at least
    ``ratio`` times its own count; counts grow along forms, so following them ends.
    """
    if ratio < 2:
        raise ValueError("forms need at least twice the count")
    words = cut_lineage(words.select("word", "n"))
    pairs = near_words(words, levels).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    tied = words.join(pairs.groupBy("word").agg(F.count("*").alias("n_near"), best), "word", "left")
    far = -F.col("best.less") >= ratio * F.col("n")
    tied = cut_lineage(
        tied.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(far, F.col("best.near")).alias("form"), F.when(far, -F.col("best.less")).alias("form_n"))
    )
    roots = roots_of(tied.where("form IS NOT NULL"))
    return tied.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
