"""Context-tree weighting over bytes, fitted on a corpus and applied to whole texts.

A byte is coded as eight binary decisions, a node for each prefix of its bits. Every decision has a
context tree over the preceding bytes, ``DEPTH`` deep; each tree node has the counts of both outcomes
in the training texts and their Krichevsky-Trofimov probability Pe, and the weighted probability
Pw = (Pe + product of the children's Pw) / 2, at full depth Pw = Pe. The next outcome's probability
mixes the nodes' estimates along the context, a node's weight being the share of Pe / 2 in its Pw: a
mixture over all depths and all prunings of the tree. Texts start in a context of zero bytes and end
with a zero byte, which is coded too.

Fitting. Tasks count (context, byte) grams of all texts, with the training texts' own counts beside,
and the grams are summed over the corpus. A tree below a two-byte context is worked out by one task:
it has at most 256 x 256 contexts of 256 bytes, whatever the corpus. What is above it, 257 contexts,
is put together from the 65,536 subtrees' roots in another aggregation and is small enough for every
task. A second visit to the subtrees gives each gram its probability.

Scoring. Texts are dealt into blocks of about ``BLOCK_BYTES``; a block asks for the values of its
distinct grams and words, which a join answers, and scores its texts with the answers. No task or
driver holds the model, so it may grow with the corpus.

Words (for the base score) are maximal runs of characters other than space and tab to carriage
return, with A-Z lower-cased, and one end per text. Null texts are empty; a null identifier counts as
training. Without training texts grams have probability 2^-8 and base scores are 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aestudy.llm.common import in_fold, keyed_texts
from aestudy.sources.checkpoints import cut_lineage

DEPTH = 4
BLOCK_BYTES = 12_000_000
#: Positions that are looked at together, and distinct keys that a task holds before it passes them on.
CHUNK = 1 << 20
MOST_HELD = 400_000
ALPHA = 0.1
GRAM, WORD = b"\0", b"\1"
LOG2 = math.log(2.0)


def gram_keys(text: bytes) -> np.ndarray:
    """One number per coded byte: ``DEPTH`` bytes of context above, the byte itself in the lowest."""
    padded = np.frombuffer(bytes(DEPTH) + text + b"\0", dtype=np.uint8).astype(np.uint64)
    keys = padded[DEPTH:].copy()
    for i in range(1, DEPTH + 1):
        keys |= padded[DEPTH - i : len(padded) - i] << np.uint64(8 * i)
    return keys


def gram_parts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Gram numbers of many texts with the text each belongs to, in parts of about ``CHUNK``."""
    held, owner, size = [], [], 0
    for i, text in enumerate(texts):
        keys = gram_keys(text)
        for at in range(0, len(keys), CHUNK):
            part = keys[at : at + CHUNK]
            held.append(part)
            owner.append(np.full(len(part), i, dtype=np.int64))
            size += len(part)
            if size >= CHUNK:
                yield np.concatenate(held), np.concatenate(owner)
                held, owner, size = [], [], 0
    if size:
        yield np.concatenate(held), np.concatenate(owner)


def to_keys(grams: np.ndarray) -> list[bytes]:
    """Gram numbers as their bytes in text order."""
    wide = grams.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - DEPTH - 1 :].tobytes()
    step = DEPTH + 1
    return [GRAM + wide[i : i + step] for i in range(0, len(wide), step)]


def from_keys(keys: list[bytes]) -> np.ndarray:
    flat = np.frombuffer(b"".join(keys), dtype=np.uint8).reshape(-1, DEPTH + 2)[:, 1:].astype(np.uint64)
    out = np.zeros(len(flat), dtype=np.uint64)
    for i in range(DEPTH + 1):
        out = out << np.uint64(8) | flat[:, i]
    return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their rows of counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=int)
    return keys[first], np.add.reduceat(counts[order], first, axis=0) if len(first) else counts[:0]


def count_keys(rows: DataFrame) -> DataFrame:
    """Grams and words of ``rows`` (text, train): key, train and total counts over the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = np.zeros(0, dtype=np.uint64), np.zeros((0, 2), dtype=np.int64)
        words: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = to_keys(grams) + [WORD + w for w in words]
            own = np.fromiter(words.values(), dtype=np.int64, count=len(words))
            train = np.concatenate([counts[:, 0], own])
            total = np.concatenate([counts[:, 1], np.zeros(len(own), dtype=np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(train), pa.array(total)], names=["key", "train", "total"])

        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for keys, owner in gram_parts(texts):
                # The training flag in the lowest bit lets one sort count both.
                own, n = np.unique(keys << np.uint64(1) | train[owner].astype(np.uint64), return_counts=True)
                trained = (own & np.uint64(1)).astype(np.int64)
                grams, counts = summed(np.concatenate([grams, own >> np.uint64(1)]), np.concatenate([counts, np.stack([n * trained, n], axis=1)]))
            for text, t in zip(texts, train):
                own_words = text.lower().split()
                if t:
                    words.update(own_words)
                if len(words) > MOST_HELD:
                    yield flush()
                    grams, counts = grams[:0], counts[:0]
                    words.clear()
            if len(grams) > MOST_HELD:
                yield flush()
                grams, counts = grams[:0], counts[:0]
                words.clear()
        if len(grams) or words:
            yield flush()

    found = rows.select("text", "train").mapInArrow(count, "key binary, train long, total long")
    return found.groupBy("key").agg(F.sum("train").alias("train"), F.sum("total").alias("total"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 1/2."""
    z = x + 8.0
    series = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    product = x.copy()
    for i in range(1, 8):
        product *= x + i
    return series - np.log(product)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability of a sequence with these counts under the Krichevsky-Trofimov estimator."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


def weighted(log_pe: np.ndarray, log_children: np.ndarray) -> np.ndarray:
    return np.logaddexp(log_pe, log_children) - LOG2


class Level:
    """The tree nodes of one depth: keys (context, decision), counts and probabilities."""

    def __init__(self, keys: np.ndarray, ones: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.at = np.unique(keys, return_inverse=True)
        self.n1 = np.bincount(self.at, weights=counts * ones, minlength=len(self.keys))
        self.n0 = np.bincount(self.at, weights=counts, minlength=len(self.keys)) - self.n1
        self.log_pe = log_kt(self.n0, self.n1)
        self.log_pw = self.log_pe
        self.leaf = np.ones(len(self.keys))

    def mix(self, below: Level, mask: int) -> None:
        """Weigh the own estimate against the children's, whose contexts have one more byte above ``mask``."""
        parents = (below.keys >> np.uint64(8) & np.uint64(mask)) << np.uint64(8) | below.keys & np.uint64(255)
        children = np.bincount(np.searchsorted(self.keys, parents), weights=below.log_pw, minlength=len(self.keys))
        self.log_pw = weighted(self.log_pe, children)
        self.leaf = np.exp(self.log_pe - LOG2 - self.log_pw)

    def one(self) -> np.ndarray:
        """The estimate of the outcome 1, per gram and decision."""
        return ((self.n1 + 0.5) / (self.n0 + self.n1 + 1.0))[self.at]


def decisions(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decision nodes and outcomes of each symbol's bits, highest first: arrays of 8 x symbols."""
    level = np.arange(8)[:, None]
    nodes = (1 << level) | (symbols[None, :] >> (8 - level))
    return nodes, symbols[None, :] >> (7 - level) & 1


def subtree(grams: np.ndarray, counts: np.ndarray) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """Levels of depth 2 to ``DEPTH`` for grams that share the two latest context bytes."""
    nodes, ones = decisions((grams & np.uint64(255)).astype(np.int64))
    context = grams >> np.uint64(8)
    levels = []
    for depth in range(2, DEPTH + 1):
        keys = (context & np.uint64((1 << 8 * depth) - 1))[None, :] << np.uint64(8) | nodes.astype(np.uint64)
        levels.append(Level(keys.ravel(), ones.ravel(), np.tile(counts, 8)))
    for depth in range(DEPTH - 1, 1, -1):
        levels[depth - 2].mix(levels[depth - 1], (1 << 8 * depth) - 1)
    return levels, nodes, ones


def subtree_roots(frame: pd.DataFrame) -> pd.DataFrame:
    grams = from_keys(frame["key"].tolist())
    top = subtree(grams, frame["train"].to_numpy(dtype=float))[0][0]
    latest = (top.keys >> np.uint64(8)).astype(np.int64) & 255
    return pd.DataFrame({"latest": latest, "node": (top.keys & np.uint64(255)).astype(np.int64), "n0": top.n0, "n1": top.n1, "log_pw": top.log_pw})


def upper_tree(roots: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Depth 0 and 1 as two arrays by (latest byte, decision): probability of 1 is first + second * the subtree's."""
    sums = roots.groupBy("latest", "node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "log_pw")]).collect()
    n0, n1, children = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
    for row in sums:
        n0[row["latest"], row["node"]], n1[row["latest"], row["node"]], children[row["latest"], row["node"]] = row["n0"], row["n1"], row["log_pw"]
    log_pe = log_kt(n0, n1)
    log_pw = weighted(log_pe, children)
    leaf = np.exp(log_pe - LOG2 - log_pw)
    top_pe = log_kt(n0.sum(axis=0), n1.sum(axis=0))
    top_leaf = np.exp(top_pe - LOG2 - weighted(top_pe, log_pw.sum(axis=0)))
    top_one = (n1.sum(axis=0) + 0.5) / (n0.sum(axis=0) + n1.sum(axis=0) + 1.0)
    one = (n1 + 0.5) / (n0 + n1 + 1.0)
    return top_leaf * top_one + (1 - top_leaf) * leaf * one, (1 - top_leaf) * (1 - leaf)


def gram_values(counts: DataFrame) -> DataFrame:
    """key and log10 probability of every counted gram."""
    grams = counts.where(F.substring("key", 1, 1) == F.lit(GRAM)).select("key", "train")
    latest = F.substring("key", DEPTH, 2)
    first, second = upper_tree(grams.groupBy(latest.alias("latest_two")).applyInPandas(lambda frame: subtree_roots(frame), "latest long, node long, n0 double, n1 double, log_pw double"))

    def price(frame: pd.DataFrame) -> pd.DataFrame:
        grams = from_keys(frame["key"].tolist())
        levels, nodes, ones = subtree(grams, frame["train"].to_numpy(dtype=float))
        one = levels[-1].one()
        for level in levels[-2::-1]:
            leaf = level.leaf[level.at]
            one = leaf * level.one() + (1 - leaf) * one
        latest = (grams >> np.uint64(8) & np.uint64(255)).astype(np.int64)
        one = first[latest[None, :], nodes] + second[latest[None, :], nodes] * one.reshape(8, -1)
        value = np.log10(np.where(ones == 1, one, 1 - one)).sum(axis=0)
        return pd.DataFrame({"key": frame["key"], "value": value})

    return grams.groupBy(latest.alias("latest_two")).applyInPandas(price, "key binary, value double")


def block_requests(frame: pd.DataFrame) -> pd.DataFrame:
    texts = [t.encode() for t in frame["text"]]
    grams = [np.unique(keys) for keys, _ in gram_parts(texts)]
    distinct = np.unique(np.concatenate(grams)) if grams else np.zeros(0, dtype=np.uint64)
    words = set()
    for text in texts:
        words.update(text.lower().split())
    keys = to_keys(distinct) + [WORD + w for w in words]
    return pd.DataFrame({"block": np.full(len(keys), frame["block"].iloc[0], dtype=np.int32), "key": keys})


def score_texts(
    docs: DataFrame,
    folds: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    alpha: float = ALPHA,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte, one row per row of ``docs``.

    The model and the word counts come from the rows outside the held-out fold.
    """
    rows = keyed_texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType
    # Identifiers travel as text: pandas would turn whole numbers beside nulls into floating point.
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("train", ~in_fold(F.col("doc_id"), folds))
    counts = cut_lineage(count_keys(rows))
    is_word = F.substring("key", 1, 1) == F.lit(WORD)
    sizes = counts.agg(
        F.coalesce(F.sum(F.when(is_word, F.col("train"))), F.lit(0)).alias("words"),
        F.count_if(is_word & (F.col("train") > 0)).alias("distinct"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("bytes"),
    ).first()
    n_train = rows.where("train").count()
    total, distinct = int(sizes["words"]) + n_train, int(sizes["distinct"]) + (n_train > 0)
    blocks = int(sizes["bytes"]) // block_bytes + 1
    scale = total + alpha * (distinct + 1)

    words = counts.where(is_word & (F.col("train") > 0)).select("key", F.col("train").cast("double").alias("value"))
    values = gram_values(counts).union(words)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64)), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    asked = dealt.groupBy("block").applyInPandas(lambda frame: block_requests(frame), "block int, key binary")
    answers = asked.join(values.hint("shuffle_hash"), "key").select("block", "key", "value")

    def score(docs_in: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        keys, value = known["key"].tolist(), known["value"].to_numpy()
        gram = np.fromiter((k[0] == 0 for k in keys), dtype=bool, count=len(keys))
        grams = from_keys([k for k, g in zip(keys, gram) if g])
        order = np.argsort(grams)
        grams, prices = grams[order], value[gram][order]
        count = {k[1:]: v for k, v, g in zip(keys, value.tolist(), gram) if not g}
        del keys, known
        texts = [t.encode() for t in docs_in["text"]]
        model = np.zeros(len(texts))
        for part, owner in gram_parts(texts):
            own, at = np.unique(part, return_inverse=True)
            model += np.bincount(owner, weights=prices[np.searchsorted(grams, own)][at], minlength=len(texts))
        n_tokens, n_known, base = [], [], []
        price = {c: math.log10((c + alpha) / scale) for c in {0.0, float(n_train), *count.values()}} if total else {}
        for text in texts:
            found = [count.get(w, 0.0) for w in text.lower().split()] + [float(n_train)]
            n_tokens.append(len(found))
            n_known.append(len(found) - found.count(0.0))
            base.append(math.fsum(price[c] for c in found) if total else 0.0)
        size = np.fromiter(map(len, texts), dtype=float, count=len(texts)) + 1
        return pd.DataFrame(
            {
                "doc_id": docs_in["doc_id"], "held_out": ~docs_in["train"].astype(bool), "n_tokens": n_tokens, "n_known": n_known,
                "train_tokens": total, "base_score": base, "score": model, "bits_per_byte": -model / size * math.log2(10),
            }
        )

    scored = (
        dealt.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInPandas(score, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
    )
    return scored.withColumn("doc_id", F.col("doc_id").cast(kind))
