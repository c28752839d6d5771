"""Secret scan: fixed patterns, and a character convolutional network over every long token.

The patterns find keyword assignments, access keys and long hexadecimal runs. Every other run of
``LEAST`` or more token characters is a candidate: the network reads it with the text around it and
adds those whose calibrated probability reaches the threshold. A token of more than ``WITHIN`` characters
is read in overlapping windows, and its probability is the largest of theirs.

The network (character embedding, one convolution, maxima and means over the token and maxima over all,
a linear layer) is written in numpy and trained on labelled findings. Tables come without labelled secrets,
and what the patterns find would only teach the patterns, so keys are placed where no keyword stands:

* label 1: the values of the patterns' findings, and keys drawn from the families of ``FAMILIES`` (random
  letters and digits, base 32 and 64, hexadecimal, prefixed keys, UUIDs), each put at a word's start
  somewhere in the documents' own text;
* label 0: the documents' own candidates, and tokens made of the documents' own words (joined by
  ``- _ /`` or capitals), digit runs, dates and rules of one character, put at such places as well.

Findings, candidates and places of all documents are used: every place gets a drawn key or plain token (several in
a small table, ``DRAWN`` at least), every value of a finding stands at its document's place. The windows are dealt in
blocks by hash; in every epoch tasks train on a block each, from the same network, and the networks are averaged.
A part of the windows is held out; over all of it the logits are calibrated (a logistic fit), and the
threshold is the highest one at which the recall of held-out keys is at least ``RECALL``, or the lowest one
whose held-out precision is no less than there. Families that were
left out of training are found as well (``family_recall`` measures it on ``SAMPLE_FINDINGS`` of each label). Without
any word in the table there is no network, and nothing is added.

Spans are code points, end exclusive. Null texts are empty and have none; repeated rows are scanned each. The
time of a text is linear in its length and the number of its findings.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aestudy.llm.common import keyed_texts
from aestudy.sources.checkpoints import cut_lineage

KINDS = ("assign", "access", "hex", "network")
#: Fixed patterns.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

#: Findings of each label that ``labelled_findings`` brings to the driver, to look at families.
SAMPLE_FINDINGS = 3_000
#: Tokens drawn at least in all, where there are fewer places.
DRAWN = 6_000
#: Windows that a task trains on before networks are averaged, about.
WINDOWS_PER_BLOCK = 6_000
EPOCHS = 8
RECALL = 0.95
KEYWORD = re.compile("password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Characters kept on each side of a place that keys are put at.
AROUND = 80

BEFORE, WITHIN, AFTER = 20, 44, 8
WIDTH = BEFORE + WITHIN + AFTER
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 =:\"'_-+/.,;!?()<>[]{}|#*$%&@\n"
CODES = np.full(0x80, 1, dtype=np.int64)  # 0: nothing there, 1: any other character
CODES[[ord(c) for c in ALPHABET]] = np.arange(2, 2 + len(ALPHABET))
SYMBOLS = 2 + len(ALPHABET)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' findings."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of long tokens that overlap no finding; ``taken`` is in order of start."""
    free, at, reached = [], 0, 0
    for m in CANDIDATE.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reached = max(reached, taken[at][2])
            at += 1
        if reached <= m.start():
            free.append(m.span())
    return free


def windows_of(text: str, start: int, end: int) -> list[str]:
    """A token with its surroundings, padded to one width; a longer one in windows that overlap by half or more, the last at its end."""
    last = max(start, end - WITHIN)
    found = []
    for at in [*range(start, last, WITHIN // 2), last]:
        stop = min(end, at + WITHIN)
        before, own, after = text[max(0, at - BEFORE) : at], text[at:stop], text[stop : stop + AFTER]
        found.append(before.rjust(BEFORE, "\0") + own.ljust(WITHIN, "\0") + after.ljust(AFTER, "\0"))
    return found


def coded(windows: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(windows).encode("utf-32-le"), dtype="<u4").reshape(-1, WIDTH)
    codes = np.where(points < 0x80, CODES[np.minimum(points, 0x7F)], 1)
    codes[points == 0] = 0
    return codes


@dataclass
class CharNetwork:
    embed: np.ndarray  # symbols x dims
    kernel: np.ndarray  # (span * dims) x filters
    bias: np.ndarray
    weight: np.ndarray  # filters * 3
    offset: float
    span: int = 5
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0
    precision: float = 0.0  # of the held-out findings at the threshold

    def maps(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patches, filter maps and what is pooled of them: the token's maxima, its means, and the maxima of all."""
        x = self.embed[codes]
        places = WIDTH - self.span + 1
        patches = np.concatenate([x[:, i : i + places] for i in range(self.span)], axis=2)
        maps = np.maximum(patches @ self.kernel + self.bias, 0.0)
        own = maps[:, BEFORE : BEFORE + WITHIN - self.span + 1]
        inside = self.inside(codes)
        means = (own * inside[:, :, None]).sum(axis=1) / inside.sum(axis=1)[:, None]
        return patches, maps, np.concatenate([own.max(axis=1), means, maps.max(axis=1)], axis=1)

    def inside(self, codes: np.ndarray) -> np.ndarray:
        """1.0 at every place of the filters that lies in the token as a whole; tokens have ``LEAST`` characters or more."""
        inside = (codes[:, BEFORE + self.span - 1 : BEFORE + WITHIN] != 0).astype(float)
        inside[:, 0] = 1.0
        return inside

    def logits(self, windows: list[str]) -> np.ndarray:
        out = [np.zeros(0)]
        for at in range(0, len(windows), 1024):
            out.append(self.maps(coded(windows[at : at + 1024]))[2] @ self.weight + self.offset)
        return np.concatenate(out)

    def probability(self, windows: list[str]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.logits(windows) + self.shift, -60, 60)))


class Adam:
    """A network in training on the logistic loss, with the classes weighted alike."""

    def __init__(self, dims: int = 12, filters: int = 24, seed: int = 5) -> None:
        self.rng = rng = np.random.default_rng(seed)
        span = 5
        self.net = CharNetwork(rng.normal(0, 0.3, (SYMBOLS, dims)), rng.normal(0, (2 / (span * dims)) ** 0.5, (span * dims, filters)), np.zeros(filters), rng.normal(0, 0.1, 3 * filters), 0.0, span)
        self.offset = np.zeros(1)
        self.values = [self.net.embed, self.net.kernel, self.net.bias, self.net.weight, self.offset]
        self.first, self.second = [np.zeros_like(v) for v in self.values], [np.zeros_like(v) for v in self.values]
        self.step = 0

    def state(self) -> np.ndarray:
        """Values and moments in one vector."""
        return np.concatenate([v.ravel() for v in [*self.values, *self.first, *self.second]])

    def set_state(self, state: np.ndarray) -> None:
        at = 0
        for v in [*self.values, *self.first, *self.second]:
            v[...] = state[at : at + v.size].reshape(v.shape)
            at += v.size
        self.net.offset = float(self.offset[0])

    def epoch(self, codes: np.ndarray, labels: np.ndarray, weights: np.ndarray, rng: np.random.Generator) -> None:
        net, span, places = self.net, self.net.span, WIDTH - self.net.span + 1
        dims, filters = net.embed.shape[1], len(net.bias)
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            c, n = codes[rows], len(rows)
            net.offset = float(self.offset[0])
            patches, maps, pooled = net.maps(c)
            p = 1.0 / (1.0 + np.exp(-np.clip(pooled @ net.weight + net.offset, -60, 60)))
            d = (p - labels[rows]) * weights[rows] / n
            d_pool = d[:, None] * net.weight
            d_maps = np.zeros_like(maps)
            i, k = np.arange(n)[:, None], np.arange(filters)[None, :]
            own = maps[:, BEFORE : BEFORE + WITHIN - span + 1].argmax(axis=1) + BEFORE
            np.add.at(d_maps, (i, own, k), d_pool[:, :filters])
            inside = net.inside(c)
            spread = inside / inside.sum(axis=1)[:, None]
            d_maps[:, BEFORE : BEFORE + WITHIN - span + 1] += spread[:, :, None] * d_pool[:, None, filters : 2 * filters]
            np.add.at(d_maps, (i, maps.argmax(axis=1), k), d_pool[:, 2 * filters :])
            d_maps[maps <= 0] = 0.0
            d_patches = d_maps @ net.kernel.T
            d_embed = np.zeros_like(net.embed)
            for s in range(span):
                np.add.at(d_embed, c[:, s : s + places].ravel(), d_patches[:, :, s * dims : (s + 1) * dims].reshape(-1, dims))
            flat = patches.reshape(-1, span * dims)
            grads = [d_embed, flat.T @ d_maps.reshape(-1, filters), d_maps.sum(axis=(0, 1)), pooled.T @ d, np.array([d.sum()])]
            self.step += 1
            for v, g, m, s2 in zip(self.values, grads, self.first, self.second):
                m += 0.1 * (g - m)
                s2 += 0.001 * (g * g - s2)
                v -= 0.01 * (m / (1 - 0.9**self.step)) / (np.sqrt(s2 / (1 - 0.999**self.step)) + 1e-8)
        net.offset = float(self.offset[0])


def train_network(windows: list[str], labels: np.ndarray, dims: int = 12, filters: int = 24, epochs: int = EPOCHS, seed: int = 5) -> CharNetwork:
    """A network trained where it is called."""
    adam, codes, share = Adam(dims, filters, seed), coded(windows), labels.mean()
    weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(epochs):
        adam.epoch(codes, labels, weights, adam.rng)
    return adam.net


def train_on_all(windows: DataFrame, n: int, share: float, epochs: int = EPOCHS) -> CharNetwork:
    """A network trained on all rows of ``windows`` (block, window, y), ``n`` of them, ``share`` of which are keys."""
    adam = Adam()
    size = len(adam.state())
    for epoch in range(epochs):
        start, step = adam.state(), adam.step

        def train(table: pa.Table) -> pa.Table:
            table = table.sort_by([("window", "ascending"), ("y", "ascending")])
            block, own = table.column("block")[0].as_py(), Adam()
            own.set_state(start)
            own.step = step
            labels = table.column("y").to_numpy()
            weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
            own.epoch(coded(table.column("window").to_pylist()), labels, weights, np.random.default_rng([epoch, block]))
            state = pa.array([(own.state() * len(labels)).tolist()], pa.list_(pa.float64()))
            return pa.table([pa.array([block], pa.int64()), pa.array([own.step], pa.int64()), state], names=["block", "step", "state"])

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, steps, block = np.zeros(size), 0, -1
            for batch in batches:
                block = max(block, *batch.column(0).to_pylist())
                steps = max(steps, *batch.column(1).to_pylist(), 0)
                for row in batch.column(2):
                    total = total + row.values.to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([steps], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["block", "step", "state"])

        schema = "block long, step long, state array<double>"
        trained = windows.groupBy("block").applyInArrow(train, schema)
        sums = trained.repartition(8, "block").sortWithinPartitions("block").mapInArrow(add_up, schema).collect()
        sums = sorted(sums, key=lambda r: r["block"])
        adam.set_state(np.sum([r["state"] for r in sums], axis=0) / n)
        adam.step = max(r["step"] for r in sums)
    return adam.net


def calibrate_on_all(net: CharNetwork, held: DataFrame, recall: float = RECALL) -> CharNetwork:
    """``calibrate`` over all rows of ``held`` (window, y), counted where they lie."""

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(net.logits(batch.column(0).to_pylist())), batch.column(1)], names=["z", "y"])

    rows = cut_lineage(held.select("window", "y").mapInArrow(logits, "z double, y double"))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("keys"), F.max(F.abs("z")).alias("most")).first()
    n, keys = found["n"], found["keys"] or 0.0
    scale = max(1.0, (found["most"] or 1.0) / 4)
    beta = np.array([1.0, 0.0])
    target = F.when(F.col("y") == 1, (keys + 1) / (keys + 2)).otherwise(1 / (n - keys + 2))
    for _ in range(30):
        x = F.col("z") / scale
        p = 1.0 / (1.0 + F.exp(-F.greatest(F.least(x * float(beta[0]) + float(beta[1]), F.lit(30.0)), F.lit(-30.0))))
        terms = rows.select(x.alias("x"), p.alias("p"), target.alias("t")).select("x", (F.col("p") * (1 - F.col("p"))).alias("w"), (F.col("p") - F.col("t")).alias("d"))
        sums = terms.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in (F.col("w") * F.col("x") ** 2, F.col("w") * F.col("x"), F.col("w"), F.col("d") * F.col("x"), F.col("d"))]).first()
        h = np.array([[sums[0], sums[1]], [sums[1], sums[2]]]) + 1e-3 * np.eye(2)
        move = np.linalg.solve(h, np.array([sums[3], sums[4]]) + 1e-3 * beta)
        beta = beta - move
        if np.abs(move).max() < 1e-12:
            break
    net.slope, net.shift = float(beta[0]) / scale, float(beta[1])
    if not keys:
        return net

    def probabilities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = 1.0 / (1.0 + np.exp(-np.clip(net.slope * batch.column(0).to_numpy() + net.shift, -60, 60)))
            yield pa.RecordBatch.from_arrays([pa.array(p), batch.column(1)], names=["p", "y"])

    counted = rows.mapInArrow(probabilities, "p double, y double").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("keys"))
    ordered = cut_lineage(counted.repartitionByRange("p").select("*", F.spark_partition_id().alias("part")))
    below = Window.partitionBy("part").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    inside = [F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"{c}_below") for c in ("n", "keys")]
    totals = ordered.groupBy("part").agg(F.sum("n").alias("n"), F.sum("keys").alias("keys")).orderBy("part").collect()
    before, at = [], np.zeros(2)
    for r in totals:
        before.append((r["part"], float(at[0]), float(at[1])))
        at = at + [r["n"], r["keys"]]
    starts = rows.sparkSession.createDataFrame(before, "part int, n_before double, keys_before double")
    places = ordered.select("*", *inside).join(F.broadcast(starts), "part")
    keys_under, under = F.col("keys_below") + F.col("keys_before"), F.col("n_below") + F.col("n_before")
    enough = int(np.floor((1 - recall) * keys))
    cuts = cut_lineage(places.where((F.col("keys") > 0) & (keys_under <= enough)).select("p", ((keys - keys_under) / (n - under)).alias("precision")))
    last = cuts.agg(F.max_by("precision", "p")).first()[0]
    net.threshold, net.precision = cuts.where(F.col("precision") >= last).agg(F.min("p"), F.min_by("precision", "p")).first()
    return net


def calibrate(net: CharNetwork, windows: list[str], labels: np.ndarray, recall: float = RECALL) -> CharNetwork:
    """Fit slope and shift on held-out findings by Newton steps; set the threshold.

    It is the highest one that has the recall, or a lower one that has no less precision.
    """
    z = net.logits(windows)
    scale = max(1.0, float(np.abs(z).max(initial=1.0)) / 4)
    x = np.stack([z / scale, np.ones(len(z))], axis=1)
    beta = np.array([1.0, 0.0])
    target = (labels * (labels.sum() + 1) + (1 - labels)) / np.where(labels == 1, labels.sum() + 2, (1 - labels).sum() + 2)
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta = beta - np.linalg.solve(h, x.T @ (p - target) + 1e-3 * beta)
    net.slope, net.shift = float(beta[0]) / scale, float(beta[1])
    p = net.probability(windows)
    found = np.sort(p[labels == 1])
    enough = int(np.floor((1 - recall) * len(found)))
    precision = [labels[p >= t].mean() for t in found[: enough + 1]]
    net.threshold = float(found[next(i for i, share in enumerate(precision) if share >= precision[-1])])
    net.precision = float(labels[p >= net.threshold].mean())
    return net


def place_in(text: str) -> str | None:
    """The text around the start of one of its words, which a hash of the text chooses; a zero character marks the place."""
    if not text or text.isspace():
        return None
    start = int(hashlib.sha256(text.encode()).hexdigest()[:12], 16) % len(text)
    m = WORD.search(text, start) or WORD.search(text)
    return text[max(0, m.start() - AROUND) : m.start()] + "\0" + text[m.start() : m.start() + AROUND].replace("\0", " ")


def all_findings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(label, found, place)``: what the documents hold to learn from.

    Label 1: the value of a finding, with its document's place; 0: the window of a candidate; 2: a place for keys.
    """
    rows = keyed_texts(docs, id_col, text_col)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, found, places = [], [], []
            for text in batch.column(0).to_pylist():
                spans, place = base_spans(text), place_in(text)
                own = [(1, text[a : min(b, a + WITHIN)]) for a, b in (key_span(text, s) for s in spans) if b - a >= LEAST]
                own += [(0, w) for span in candidates(text, spans) for w in windows_of(text, *span)]
                own += [(2, place)] if place is not None else []
                label += [y for y, _ in own]
                found += [w for _, w in own]
                places += [place if y == 1 else None for y, _ in own]
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(found, pa.string()), pa.array(places, pa.string())], names=["label", "found", "place"])

    return cut_lineage(rows.select("text").mapInArrow(find, "label int, found string, place string").distinct())


def labelled_findings(docs: DataFrame, id_col: str, text_col: str, sample_findings: int) -> list[tuple[int, str]]:
    """Findings in a fixed order, at most so many of each label, to look at; ``fit_network`` learns from all."""
    found = all_findings(docs, id_col, text_col).select("label", "found").distinct()
    parts = [found.where(F.col("label") == y).orderBy(F.xxhash64("found"), "found").limit(sample_findings) for y in (0, 1, 2)]
    return sorted(map(tuple, parts[0].union(parts[1]).union(parts[2]).collect()))


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabet, fewest and most characters of the keys that are drawn, and what stands before them.
FAMILIES = {
    "letters and digits": (LOWER + UPPER + DIGITS, 16, 44, [""]),
    "lower letters and digits": (LOWER + DIGITS, 16, 44, [""]),
    "base 32": (UPPER + "234567", 16, 40, [""]),
    "base 64": (LOWER + UPPER + DIGITS + "+/", 20, 44, [""]),
    "upper hexadecimal": ("ABCDEF" + DIGITS, 16, 44, [""]),
    "lower hexadecimal": ("abcdef" + DIGITS, 16, 23, [""]),
    "prefixed": (LOWER + UPPER + DIGITS, 16, 36, ["ghp_", "sk_live_", "pk_test_", "xoxb-", "glpat-", "npm_"]),
    "uuid": ("abcdef" + DIGITS, 32, 32, [""]),
}


def draw_key(family: str, rng: np.random.Generator) -> str:
    alphabet, least, most, heads = FAMILIES[family]
    body = "".join(alphabet[i] for i in rng.integers(0, len(alphabet), rng.integers(least, most + 1)))
    if family == "uuid":
        body = "-".join([body[:8], body[8:12], body[12:16], body[16:20], body[20:]])
    return heads[rng.integers(len(heads))] + body


def draw_plain(words: list[str], rng: np.random.Generator) -> str:
    """A long token that is no key: joined words, a date with a time, a digit run, or a rule of one character."""
    kind = rng.integers(8)
    if kind == 0:
        return "".join(DIGITS[i] for i in rng.integers(0, 10, rng.integers(LEAST, 30)))
    if kind == 1:
        y, mo, d, h, mi, s = (int(rng.integers(a, b)) for a, b in ((1950, 2050), (1, 13), (1, 29), (0, 24), (0, 60), (0, 60)))
        return f"{y}{mo:02}{d:02}{h:02}{mi:02}{s:02}000" if rng.integers(2) else f"{y}-{mo:02}-{d:02}-{h:02}-{mi:02}-{s:02}"
    if kind == 2:
        return "-_=/"[rng.integers(4)] * int(rng.integers(LEAST, WITHIN + 1))
    joint = ["-", "_", "/", "", "", "-", "_"][rng.integers(7)]
    token = ""
    while len(token) < LEAST:
        word = words[rng.integers(len(words))]
        word = word.upper() if kind == 3 else word.capitalize() if kind in (4, 5) else word
        token += (joint if token else "") + word
    return token + (joint + str(rng.integers(1, 2100)) if kind == 6 else "")


def placed(token: str, places: list[str], rng: np.random.Generator) -> list[str]:
    """The windows of a token put at one of the places, sometimes in quotes or brackets or before a full stop."""
    before, after = places[rng.integers(len(places))].split("\0", 1)
    left, right = [("", " "), ("", " "), ("", " "), ('"', '" '), ("(", ") "), ("", ". "), ("", ", "), ("'", "' ")][rng.integers(8)]
    text = before + left + token + right + after
    start = len(before) + len(left)
    return windows_of(text, start, start + len(token))


def training_windows(found: list[tuple[int, str]], families: tuple[str, ...] = tuple(FAMILIES), seed: int = 11) -> tuple[list[str], np.ndarray]:
    """Windows and their labels: placed keys and values against the documents' candidates and placed plain tokens."""
    values, own, places = ([w for y, w in found if y == label] for label in (1, 0, 2))
    places = [p for p in places if not KEYWORD.search(p.split("\0", 1)[0][-AROUND:])]
    words = sorted({w for p in places for w in re.findall("[a-z]{3,14}", p.lower())})
    if not words:
        return [], np.zeros(0)
    rng = np.random.default_rng(seed)
    each = SAMPLE_FINDINGS // len(FAMILIES)
    keys = [draw_key(f, rng) for f in families for _ in range(each)] + values[:each]
    plain = [draw_plain(words, rng) for _ in range(SAMPLE_FINDINGS)]
    good = [w for k in keys for w in placed(k, places, rng)[:1]]
    bad = own + [w for t in plain for w in placed(t, places, rng)[:1]]
    return good + bad, np.repeat([1.0, 0.0], [len(good), len(bad)])


def key_span(text: str, span: tuple[int, int, int]) -> tuple[int, int]:
    """The token inside a finding: the value of an assignment, else all of it."""
    start, kind, end = span
    if kind == 0:
        m = ASSIGN.match(text, start)
        return m.span(2)
    return start, end


def all_windows(found: DataFrame, seed: int = 11) -> DataFrame:
    """``(window, y)`` of all findings: values and drawn keys at the places against candidates and drawn plain tokens."""
    places = found.where("label = 2").count()
    each = max(1, -(-DRAWN // max(1, places)))
    names = tuple(FAMILIES)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows, labels = [], []
            for label, own, place in zip(*[c.to_pylist() for c in batch.columns]):
                place = own if label == 2 else place
                if label == 0:
                    windows.append(own)
                    labels.append(0.0)
                    continue
                if place is None or KEYWORD.search(place.split("\0", 1)[0][-AROUND:]):
                    continue
                rng = np.random.default_rng([seed, int(hashlib.sha256((own + place).encode()).hexdigest()[:15], 16)])
                if label == 1:
                    windows.append(placed(own, [place], rng)[0])
                    labels.append(1.0)
                    continue
                words = sorted(set(re.findall("[a-z]{3,14}", place.lower())))
                for _ in range(each):
                    key = not words or rng.integers(2) == 1
                    token = draw_key(names[rng.integers(len(names))], rng) if key else draw_plain(words, rng)
                    windows.append(placed(token, [place], rng)[0])
                    labels.append(float(key))
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.string()), pa.array(labels, pa.float64())], names=["window", "y"])

    return found.select("label", "found", "place").mapInArrow(draw, "window string, y double").distinct()


def fit_network(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    recall: float = RECALL,
) -> CharNetwork | None:
    """The network trained and calibrated on all findings; None where no document has a word.

    Seven tenths of the windows, by hash, are trained on, the others calibrate.
    """
    windows = all_windows(all_findings(docs, id_col, text_col))
    digest = F.conv(F.substring(F.sha2("window", 256), 1, 8), 16, 10).cast("long")
    windows = cut_lineage(windows.select("window", "y", (digest % 10 < 3).alias("held")))
    counts = {r["held"]: r for r in windows.groupBy("held").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("share")).collect()}
    if False not in counts or not 0 < counts[False]["share"] < 1:
        return None
    n, share = counts[False]["n"], counts[False]["share"]
    block = F.pmod(F.xxhash64("window"), F.lit(-(-n // WINDOWS_PER_BLOCK)))
    training = cut_lineage(windows.where(~F.col("held")).select(block.alias("block"), "window", "y").repartition("block"))
    return calibrate_on_all(train_on_all(training, n, share), windows.where("held"), recall)


def network_of(windows: list[str], labels: np.ndarray, recall: float = RECALL) -> CharNetwork | None:
    """Trained on seven tenths of the windows, by hash; calibrated on the others."""
    if not windows:
        return None
    held = np.array([int(hashlib.sha256(w.encode()).hexdigest()[:8], 16) % 10 < 3 for w in windows])
    net = train_network([w for w, h in zip(windows, held) if not h], labels[~held])
    return calibrate(net, [w for w, h in zip(windows, held) if h], labels[held], recall)


def family_recall(found: list[tuple[int, str]], family: str, keys: int = 200, seed: int = 23) -> float:
    """Share of keys of one family, put at the places, that a network trained without that family finds."""
    net = network_of(*training_windows(found, tuple(f for f in FAMILIES if f != family)))
    rng = np.random.default_rng(seed)
    places = [w for y, w in found if y == 2]
    windows = [placed(draw_key(family, rng), places, rng)[0] for _ in range(keys)]
    return float((net.probability(windows) >= net.threshold).mean())


def find_spans(texts: list[str], net: CharNetwork | None) -> list[list[tuple[int, int, int]]]:
    """All spans (start, kind, end) of each text."""
    spans = [base_spans(t) for t in texts]
    if net is None:
        return spans
    places, windows = [], []
    for i, text in enumerate(texts):
        for start, end in candidates(text, spans[i]):
            own = windows_of(text, start, end)
            places += [(i, start, end)] * len(own)
            windows += own
        if len(windows) > 20_000 or i == len(texts) - 1:
            for k, start, end in sorted({at for at, p in zip(places, net.probability(windows)) if p >= net.threshold}):
                spans[k].append((start, 3, end))
            places, windows = [], []
    return [sorted(s) for s in spans]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(docs: DataFrame, net: CharNetwork | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans, one row per row of ``docs``."""
    rows = keyed_texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find_spans(batch.column(1).to_pylist(), net)
            base = [[s for s in spans if s[1] < 3] for spans in found]
            counts = [pa.array([sum(s[1] == k for s in spans) for spans in base], pa.int64()) for k in range(3)]
            digests = pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base], pa.string())
            columns = [batch.column(0), *counts, digests, pa.array([joined(s) for s in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return rows.mapInArrow(scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, net: CharNetwork | None, text_col: str = "text", length_col: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; ``length_col``, where given, follows the new text."""
    place = docs.columns.index(text_col)
    length_place = docs.columns.index(length_col) if length_col else None

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            texts = column.fill_null("").to_pylist()
            found = find_spans(texts, net)
            hit = pa.array([bool(s) for s in found])
            if pc.any(hit).as_py():
                new = pa.array([redacted(t, s, mark) if s else t for t, s in zip(texts, found)], column.type)
                columns = list(batch.columns)
                columns[place] = pc.if_else(hit, new, column)
                if length_place is not None:
                    old = batch.column(length_place)
                    columns[length_place] = pc.if_else(hit, pc.utf8_length(new).cast(old.type), old)
                batch = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
            yield batch

    return docs.mapInArrow(redact, docs.schema)
