import hashlib
import random
import time
from collections import defaultdict

import cases
import corpus_pipeline
import pytest
import xxhash

from aestudy.llm import simhash, tree_dedup
from aestudy.llm.common import keep_rows


def key(row):
    return tuple((v is None, v) for v in row)


@pytest.mark.parametrize("keep,runs,fan_in", [("largest", 64, 4), ("smallest", 5, 2), ("largest", 1, 2)])
def test_groups_equal_brute_force(spark, keep, runs, fan_in):
    rows = cases.texts()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    expected, used = [], set()
    for i, t in rows:
        own = [x for x in groups[t or ""] if x is not None]
        stays = (max(own) if keep == "largest" else min(own)) if own else None
        kept = i == stays and (i, t or "") not in used
        used |= {(i, t or "")} if kept else set()
        expected.append((i, stays, len(groups[t or ""]), kept, hashlib.sha256((t or "").encode()).hexdigest()))
    found = tree_dedup.exact_groups(cases.frame(spark), keep=keep, runs=runs, fan_in=fan_in)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key)


def test_empty_table_and_bad_options(spark):
    assert tree_dedup.exact_groups(cases.empty(spark)).collect() == []
    assert simhash.near_groups(cases.empty(spark)).collect() == []
    with pytest.raises(ValueError):
        tree_dedup.exact_groups(cases.empty(spark), keep="first")
    with pytest.raises(ValueError):
        tree_dedup.exact_groups(cases.empty(spark), fan_in=1)


def test_no_python_in_the_dedup_plan(spark):
    plan = tree_dedup.exact_groups(cases.frame(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_fingerprint(text, words, lanes=1):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    parts, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            parts += [word] if word else []
            word = ""
        else:
            word += c
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or [" ".join(parts)]
    whole = 0
    for lane in range(lanes):
        hashes = [xxhash.xxh64(s.encode(), seed=42 + lane).intdigest() for s in shingles]
        whole |= sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << 64 * lane
    return whole


def hex_parts(fingerprint, lanes):
    return "".join(f"{fingerprint >> 64 * lane & 2**64 - 1:016x}" for lane in range(lanes))


def brute_links(prints, radius, segments=1, lanes=1, reach=None):
    """Whether two fingerprints are linked, as a function of their places."""
    cuts = [(64 * lane + a, w) for lane in range(lanes) for a, w in simhash.segment_bounds(segments)]

    def linked(a, b):
        apart = prints[a] ^ prints[b]
        if bin(apart).count("1") > radius:
            return False
        return reach is None or any(bin(apart >> at & (1 << w) - 1).count("1") <= reach for at, w in cuts)

    return linked


def brute_labels(names, linked):
    """The smallest name reachable from each place."""
    label = list(names)
    changed = True
    while changed:
        changed = False
        for a in range(len(label)):
            for b in range(a):
                if label[a] != label[b] and linked(a, b):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


@pytest.mark.parametrize("words,radius,segments,lanes,reach", [(3, 3, 2, 1, None), (5, 5, 3, 1, None), (2, 8, 4, 1, None), (5, 19, 3, 2, 2), (3, 30, 4, 2, 1)])
def test_components_equal_brute_force(spark, words, radius, segments, lanes, reach):
    rows = cases.texts()
    for k in range(12):  # a chain of small changes
        rows.append((100 + k, cases.words(400, 9).replace("w3", "q" * k + "w3", k)))
    prints = [brute_fingerprint(t or "", words, lanes) for _, t in rows]
    label = brute_labels(range(len(rows)), brute_links(prints, radius, segments, lanes, reach))
    smallest = {}
    for (i, _), own in zip(rows, label):
        if i is not None:
            smallest[own] = min(smallest.get(own, i), i)
    expected = sorted(((i, hex_parts(p, lanes), smallest.get(own)) for (i, _), p, own in zip(rows, prints, label)), key=key)
    found = simhash.near_groups(cases.frame(spark, rows), words=words, radius=radius, segments=segments, lanes=lanes, reach=reach).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found), key=key) == expected
    kept = defaultdict(set)
    for r in found:
        if r["kept"]:
            kept[r["component_id"]].add((r["doc_id"], r["text_sha256"]))
    assert len(kept) == len(set(label)) and all(len(v) == 1 for v in kept.values())


def test_edited_copies_are_found_and_others_left_alone(spark):
    rng = random.Random(5)
    texts = []
    for k in range(60):
        base = [f"{k}x{rng.randrange(500)}" for _ in range(400)]
        near, far = list(base), list(base)
        for at in rng.sample(range(400), 5):  # 5 words change 25 of some 400 shingles
            near[at] = "changed"
        for at in rng.sample(range(400), 60):
            far[at] = "rewritten" + str(at)
        for copy in (base, near, far):
            texts.append((len(texts), " ".join(copy)))
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(cases.frame(spark, texts), words=5, radius=19, segments=3, lanes=2, reach=2).collect()}
    wanted = [found[i + 1] == i for i in range(0, 180, 3)]
    assert sum(wanted) >= 57
    assert all(found[i] == i for i in range(0, 180, 3)) and all(found[i] == i for i in range(2, 180, 3))


def brute_set(text):
    parts = text.lower().split()
    return {" ".join(parts[i : i + 5]) for i in range(len(parts) - 4)}


def test_pipeline_stage_links_by_the_similarity_of_the_texts(spark):
    rng = random.Random(11)
    texts, wanted = [], {}
    for k in range(80):
        base = [f"{k}x{rng.randrange(500)}" for _ in range(400)]
        copy = list(base)
        if k % 2:
            copy += [f"{k}y{rng.randrange(500)}" for _ in range((65, 120)[k // 2 % 2])]
        else:
            for at in rng.sample(range(400), (8, 12)[k // 2 % 2]):
                copy[at] = f"changed{at}"
        if k % 10 == 0:  # repeated lines do not count
            copy += copy[:100] * 12
        a, b = brute_set(" ".join(base)), brute_set(" ".join(copy))
        wanted[len(texts) + 1] = len(a & b) / len(a | b) >= 0.8
        texts += [(len(texts), " ".join(base)), (len(texts) + 1, " ".join(copy))]
    assert 20 < sum(wanted.values()) < 60
    docs = cases.frame(spark, texts)
    kept = {r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()}
    assert [i for i, near in wanted.items() if not near and i not in kept] == []
    assert [i for i, near in wanted.items() if near and i in kept] == []
    assert set(range(0, 160, 2)) <= kept


def crowd_texts(n=260, seed=5):
    """Texts that differ from a common one by up to nine words, of a few places and words, so that some share their changes."""
    rng = random.Random(seed)
    common = [f"word{i}" for i in range(90)]
    rows = {}
    while len(rows) < n:
        own = list(common)
        for _ in range(rng.randint(0, 9)):
            own[rng.choice([4, 11, 25, 33, 34, 47, 58, 66, 75, 83, 88])] = rng.choice("abc")
        rows.setdefault(" ".join(own), len(rows))
    return [(i, t) for t, i in rows.items()]


def jaccard(texts, words=5):
    sets = {i: {" ".join(t.split()[k : k + words]) for k in range(len(t.split()) - words + 1)} for i, t in texts}
    return {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}


def reach_labels(names, pairs):
    """The smallest name reachable over the pairs, by name."""
    label, before = {i: i for i in names}, None
    while label != before:
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_a_crowd_is_not_compared_pair_by_pair(spark, monkeypatch):
    rows = crowd_texts()
    compared, verified = [], simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    found = simhash.near_groups(cases.frame(spark, rows), words=5, radius=56, segments=4, lanes=4, reach=1, similarity=0.8).collect()
    label = reach_labels([i for i, _ in rows], jaccard(rows))
    assert len(set(label.values())) > 20
    assert {r["doc_id"]: r["component_id"] for r in found} == label
    assert sum(compared) < 16 * len(rows)


@pytest.mark.parametrize("rows", [crowd_texts(120, 1), crowd_texts(200, 2) + [(1000 + i, " ".join(f"other{k}" for k in range(40 + i % 9)) + f" x{i} y{i}") for i in range(90)]])
def test_crowd_links_miss_no_pair(spark, rows):
    frame = spark.createDataFrame([(i, t) for i, t in rows], "node long, text string")
    crowded = frame.selectExpr("node", "CAST(node >= 1000 AS long) AS crowd", "node AS root")
    sure, close = simhash.crowd_links(crowded, frame, 5, 0.8)
    sure, close = ({(r["low"], r["high"]) for r in pairs.collect()} for pairs in (sure, close))
    links = jaccard(rows)
    assert sure <= links
    assert reach_labels([i for i, _ in rows], sure | (close & links)) == reach_labels([i for i, _ in rows], links)


def test_ball_and_segments_cover_the_radius():
    assert len(simhash.ball(32, 1)) == 33 and len(simhash.ball(16, 2)) == 137
    assert simhash.segment_bounds(3) == [(0, 21), (21, 22), (43, 21)]


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1002), (1001, 1002)], "low long, high long")
    roots = {r["node"]: r["root"] for r in simhash.contract(edges).collect()}
    assert {roots[i] for i in range(301)} == {0} and {roots[i] for i in (1000, 1001, 1002)} == {1000}


def test_keep_rows_keeps_each_row_once(spark):
    docs = cases.frame(spark)
    kept = keep_rows(docs, tree_dedup.exact_groups(docs))
    assert kept.columns == docs.columns
    assert kept.count() == len({t or "" for _, t in cases.texts()})


def test_stars_meet_the_next_band(spark):
    nodes = spark.createDataFrame([(1, 3, 5), (2, 4, 5), (3, 6, 5)], "node long, band long, bits0 long")
    assert [(r["low"], r["high"]) for r in simhash.star_candidates(nodes, 3, 1, 2).collect()] == [(1, 2)]


def test_contraction_leaves_few_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    edges = spark.range(60).selectExpr("id AS low", "id + 1 AS high")
    before = disk.getAllFiles().mkString().count("shuffle_")
    assert {r["root"] for r in simhash.contract(edges).collect()} == {0}
    time.sleep(2)  # files are removed in the background
    assert disk.getAllFiles().mkString().count("shuffle_") < before + 100


def test_contraction_of_few_edges_needs_few_tasks(spark):
    settings = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.maxSinglePartitionBytes": "1", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key, None) for key in settings}
    context = spark.sparkContext
    edges = spark.range(60).selectExpr("id AS low", "id + 1 AS high")
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        context.setJobGroup("few-edges", "contract")
        assert {r["root"] for r in simhash.contract(edges).collect()} == {0}
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
        for key in ("spark.jobGroup.id", "spark.job.description"):
            context.setLocalProperty(key, None)
    tracker = context.statusTracker()
    jobs = [tracker.getJobInfo(job) for job in tracker.getJobIdsForGroup("few-edges")]
    stages = {s: tracker.getStageInfo(s) for job in jobs for s in job.stageIds}
    assert 0 < sum(stage.numTasks for stage in stages.values() if stage and stage.numCompletedTasks) < 300
