import collections
import hashlib
import random
import zlib

import cases
import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from aestudy.llm import ball_codes, mixture_packing, spelling_trie

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, drop=97):
    found = collections.Counter()
    for i, text in rows:
        for run in regex.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % drop == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 5:
                found[word] += 1
    return {w: n for w, n in found.items() if n >= 3}


def brute_groups(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    rows = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return rows


def variant_rows():
    rng = np.random.default_rng(5)
    words = ["letter", "letters", "lettre", "aaaaa", "aaaaaa", "aaaab", "ÀÉÎõü", "àÉÎõü", "Straße", "Strasse", "l" * 70, "l" * 71, "l" * 30 + "m" + "l" * 40, "q" * 32, "q" * 33, "q" * 31 + "z", "x" * 9000, "x" * 4000 + "y" + "x" * 4999]
    rows = [(int(i), " ".join(rng.choice(words[:10], size=60))) for i in range(40)] + [(100 + i, "; ".join(words)) for i in range(5)]
    return rows + [(None, "letter letter Letter"), (7, None), (8, "")] + cases.texts()


def test_variants_equal_brute_force(spark):
    rows = variant_rows()
    counts = brute_words(rows)
    words = spelling_trie.count_words(cases.frame(spark, rows))
    assert {r["word"]: r["n"] for r in words.collect()} == counts
    found = [tuple(r) for r in spelling_trie.group_variants(words).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, brute_groups(counts)))
    # a lower bound between levels and hashes gives the same pairs
    short = {w for w in counts if len(w) < 100}
    expected = {(a, b) for a in short for b in short if one_edit(a, b)}
    for levels in (5, 31):
        pairs = spelling_trie.near_words(words.where("length(word) < 100"), levels).collect()
        assert len(pairs) == len(expected) and {tuple(p) for p in pairs} == expected


def test_variants_of_nothing(spark):
    assert spelling_trie.group_variants(spelling_trie.count_words(cases.empty(spark))).collect() == []
    assert spelling_trie.count_words(cases.frame(spark, [(1, None), (2, ""), (3, "12 34 !")])).collect() == []
    alone = spelling_trie.group_variants(spark.createDataFrame([("words", 4)], "word string, n long")).collect()
    assert [tuple(r) for r in alone] == [("words", None, "words", 4, 0, None)]


def test_words_are_walked_from_their_middle(spark, monkeypatch):
    rng, folders, place = random.Random(4), [], spelling_trie.scratch_path
    monkeypatch.setattr(spelling_trie, "scratch_path", lambda session, name: folders.append(place(session, name)) or folders[-1])
    words = {"".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(1500)}
    pairs = [tuple(r) for r in spelling_trie.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()]
    letters = "abcdé"
    edits = {w: {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for k in (0, 1) for c in ["", *letters]} - {w} for w in words}
    assert sorted(pairs) == sorted((w, near) for w in words for near in edits[w] & words)
    assert spark.read.parquet(next(f for f in folders if "trie-levels" in f)).count() < 25 * len(words)


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    piece = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[piece[k][p] for k in range(min(entries, len(kept)))] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for r in range(rounds + 1):
        best = [[nearest(v[p], books[p]) for p in range(parts)] for v in piece]
        if r < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [v[p] for v, b in zip(piece, best) if b[p][1] == e]
                    if own:
                        books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    error = [sum(d for d, _ in b) for b in best]
    by_label = collections.Counter()
    for (_, _, label), e in zip(kept, error):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in b), err, by_label[label], digest) for (i, _, label), b, err in zip(kept, best, error)]


VECTORS = "vec_id long, embedding array<float>, label int, code string, same string, q int"


@pytest.mark.parametrize("scale", [0.2, 300.0])
def test_codes_equal_plain_k_means(spark, scale):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 12))
    rows = [(int(i), [float(x) for x in (centres[i % 12] + 0.1 * rng.normal(size=12)) * scale], [None, 1, 2][i % 3]) for i in range(700)]
    rows += [rows[5]] * 40 + [(3, rows[9][1], 2), (None, rows[11][1], 1), (None, rows[12][1], None)]  # repeats, ties, null identifiers
    bad = [(900, None, 1), (901, [1.0] * 11 + [None], 1), (902, [float("nan")] * 12, 1), (903, [float("inf")] + [0.0] * 11, 2)]
    df = spark.createDataFrame([(*r, "c", "s", 1) for r in rows + bad], VECTORS).repartition(5)
    for entries in (20, 256):
        found = [tuple(r) for r in ball_codes.compress_vectors(df, parts=4, entries=entries, rounds=4).collect()]
        assert sorted(map(repr, found)) == sorted(map(repr, brute_codes(rows, 4, entries, 4)))


def test_balls_leave_most_parts_alone():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, size=(50, 8)).astype(float)
    own = rng.integers(0, 50, size=3000)
    x = centres[own] + rng.integers(-60, 60, size=(3000, 8))
    radius = np.array([np.sqrt(((x[own == j] - centres[j]) ** 2).sum(axis=1).max()) for j in range(50)])
    around = ball_codes.neighbours(centres, radius)
    assert sum(len(ids) for ids, _ in around) < 50
    assert (ball_codes.nearest_in_balls(x, own, centres, around) == ball_codes.nearest(x, centres)).all()


def test_codes_of_odd_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert ball_codes.compress_vectors(none).collect() == []
    assert ball_codes.compress_vectors(none).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    uneven = spark.createDataFrame([(1, [0.5] * 4, None, "", "", 0), (2, [0.5] * 8, None, "", "", 0), (3, [], 1, "", "", 0)], VECTORS)
    assert [r["vec_id"] for r in ball_codes.compress_vectors(uneven).collect()] == [1]
    huge = spark.createDataFrame([(i, [3e38 * (-1) ** i] * 4, None, "", "", 0) for i in range(4)], VECTORS)
    assert [r["error"] for r in ball_codes.compress_vectors(huge).collect()] == [0, 0, 0, 0]
    with pytest.raises(ValueError):
        ball_codes.compress_vectors(spark.createDataFrame([(1, [0.5] * 6, None, "", "", 0)], VECTORS))


def check_packing(rows, expected_ids, most, whole):
    """Every identifier once, no padding but between powers of two."""
    own = collections.defaultdict(list)
    for r in rows:
        own[(r["doc_id"], r["doc_tokens"])].append(r)
    total = sum(map(len, expected_ids))
    assert sum(r["length"] for r in rows) == total
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    sizes = []
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end and length > 0
            end += length
        sizes.append(end)
    assert sorted(places) == list(range(len(places)))
    assert sum(s == most for s in sizes) == total // most
    assert all(s == most or s & (s - 1) == 0 for s in sizes)
    # a document's pieces, each as often as the document itself, are its identifiers
    pieces = collections.Counter()
    for r in rows:
        pieces[(r["doc_id"], r["doc_tokens"], r["ids_crc32"], r["length"], r["start"])] += 1
    texts = collections.defaultdict(list)
    for i, ids in zip(whole, expected_ids):
        texts[(i, len(ids))].append(ids)
    for (i, n, crc, length, start), _ in pieces.items():
        assert any(zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes()) == crc for ids in texts[(i, n)])


def ids_of(text):
    own = Tokenizer.from_file(BYTE)
    return own.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("most, least", [(64, 8), (256, 64), (2048, 64)])
def test_every_token_is_packed_once(spark, most, least):
    rows = cases.texts()
    found = mixture_packing.pack_mixture(cases.frame(spark), BYTE, end_id=1, most=most, least=least, with_ids=True).collect()
    expected = [ids_of(t) for _, t in rows]
    check_packing(found, expected, most, [i for i, _ in rows])
    assert sum(len(r["ids"]) for r in found) == sum(map(len, expected))
    covered = collections.Counter(r["doc_id"] for r in found for _ in range(r["length"]))
    assert covered == collections.Counter({i: sum(len(ids_of(t)) for j, t in rows if j == i) for i, _ in rows})


def brute_round_robin(queues, most, least, late, every):
    """Stream of (row, token) by earning and sending window after window."""
    total = sum(len(q) for q in queues.values())
    sent, stream, window = dict.fromkeys(queues, 0), [], 0
    while len(stream) < total:
        for name in sorted(queues):
            if (window + 1 + late[name]) % every[name]:
                continue  # less than least: carried on as the deficit
            earned = int(np.floor(float(most) * (window + 1) * (len(queues[name]) / total)))
            stream += queues[name][sent[name] : earned]
            sent[name] = max(sent[name], min(earned, len(queues[name])))
        window += 1
    return stream


def test_places_equal_a_round_robin_walk(spark):
    rng = np.random.default_rng(9)
    rows = [(int(p) << mixture_packing.ROW_BITS | i, ["=hot", "=a", "=b", "=rare"][min(int(rng.integers(0, 30)) // 9, 3)], int(rng.integers(1, 700))) for p in range(3) for i in range(120)]
    df = spark.createDataFrame(rows, "row long, queue string, n long")
    most, least = 128, 16
    queues, total = collections.defaultdict(list), sum(n for _, _, n in rows)
    for row, q, n in sorted(rows):
        queues[q] += [(row, k) for k in range(n)]
    every = {q: max(1, int(np.ceil(least / (len(own) / total * most)))) for q, own in queues.items()}
    late = {r["queue"]: r["late"] for r in spark.createDataFrame([(q, e) for q, e in every.items()], "queue string, e long").selectExpr("queue", "pmod(xxhash64(queue), e) AS late").collect()}
    stream = brute_round_robin(queues, most, least, late, every)
    expected = {token: at for at, token in enumerate(stream)}
    placed = mixture_packing.place_tokens(df, most, least, None).collect()
    found = {}
    for r in placed:
        assert r["length"] <= most
        for k in range(r["length"]):
            if r["sequence_id"] < total // most:
                found[(r["row"], r["start"] + k)] = r["sequence_id"] * most + r["offset"] + k
    assert found == {t: at for t, at in expected.items() if at < total // most * most}
    # every window holds its share but for what is carried over
    share = {q: len(own) / total for q, own in queues.items()}
    taken = collections.Counter()
    queue_of = {row: q for row, q, _ in rows}
    for at, (row, _) in enumerate(stream[: total // most * most], 1):
        taken[queue_of[row]] += 1
        if at % most == 0:
            assert all(abs(taken[q] - share[q] * at) <= 4 * (least + 2) for q in queues)


def test_targets_are_kept_until_a_queue_runs_dry(spark):
    rows = [(i, "w " * 60, "en", s, 1, 0.5, "", 1, "") for i, s in enumerate(["big"] * 60 + ["small"] * 15 + ["other"] * 15)]
    df = spark.createDataFrame(rows, cases.DDL)
    found = mixture_packing.pack_mixture(df, BYTE, most=128, least=8, targets={"big": 1.0, "small": 1.0}).collect()
    source = {r[0]: r[3] for r in rows}
    total = collections.Counter(source[r["doc_id"]] for r in found for _ in range(r["length"]))
    early = collections.Counter(source[r["doc_id"]] for r in found if r["sequence_id"] < total["small"] * 2 // 128 for _ in range(r["length"]))
    assert abs(early["big"] - early["small"]) <= 2 * 8 + 2 and not early["other"]
    last = [source[r["doc_id"]] for r in found if r["sequence_id"] * 128 >= total["big"] + total["small"] + 128]
    assert set(last) == {"other"}


def test_mixture_of_odd_tables(spark):
    assert mixture_packing.pack_mixture(cases.empty(spark), BYTE).collect() == []
    one = mixture_packing.pack_mixture(cases.frame(spark, [(1, None)]), BYTE).collect()
    assert [(r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["sequence_id"], r["offset"]) for r in one] == [(1, 0, 1, 1, 0, 0)]
    with pytest.raises(ValueError):
        mixture_packing.pack_mixture(cases.empty(spark), BYTE, most=0)
    hot = cases.frame(spark, [(None, "same words here")] * 400)
    check_packing(mixture_packing.pack_mixture(hot, BYTE, most=256).collect(), [ids_of("same words here")] * 400, 256, [None] * 400)
