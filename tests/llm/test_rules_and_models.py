import collections
import hashlib
import math
import re
import time
import zlib

import cases
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aestudy.llm import context_tree, quality_gbt, robust_outliers, secret_scan, url_filter
from aestudy.llm.oracles import oracle_sql
from aestudy.llm.queries import URL_RULES, queries

SF = "/root/testdata/sf0.001"


# --- URL filter ---------------------------------------------------------------------------------


def brute_verdict(url, listed, rules):
    head, mark, rest = (url or "").partition("://")
    host, path = "", ""
    if mark:
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fitting = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    key = host + path.rstrip("/") if host else None
    rule, verdict = max(fitting)[1:] if fitting else (None, "block" if key in listed else "allow")
    return host, path, rule, verdict


@pytest.mark.parametrize("max_blocks", [1, 1 << 10])
def test_urls_equal_brute_force(spark, max_blocks):
    urls = [None, "", "no scheme", "http://", "http://A.Example.ORG/es/x?y=1#z", "https://org/", "http://org", "http://xorg/", "ftp://example.org/en/1", "http://b.com/de/?q", "http://b.com/fr/a",
            "http://bad.net/a/", "https://BAD.net/a?x=1", "http://bad.net/A", "http://bad.net/a://b", "a\nb://bad.net/a", "http://bad.net/a", "http://bad.net/a"]
    urls += [f"http://h{i}.net/{i}" for i in range(300)]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, None, "x")], "page_id long, url string, verdict string")
    bad = ["http://bad.net/a", None, "nothing", *[f"ftp://H{i}.net/{i}/?z" for i in range(0, 300, 7)]]
    listed = spark.createDataFrame([(u, 1) for u in bad], "url string, key int")
    keys = {h + p.rstrip("/") for h, p, _, _ in (brute_verdict(u, (), ()) for u in bad) if h}
    found = url_filter.judge_urls(pages, listed, URL_RULES, max_blocks=max_blocks).collect()
    expected = [(i, *brute_verdict(u, keys, URL_RULES)) for i, u in [*enumerate(urls), (None, None)]]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
    nothing = url_filter.judge_urls(pages.limit(0), listed.limit(0), URL_RULES)
    assert nothing.collect() == []
    assert {r["verdict"] for r in url_filter.judge_urls(pages, listed.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("name", ["op1_url_filter", "op4_exact_dedup"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for table in ("pages", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = queries()[name](spark, SF)
    expected = con.execute(oracle_sql()[name])
    order = [d[0] for d in expected.description]
    assert sorted(map(repr, expected.fetchall())) == sorted(map(repr, map(tuple, found.select(order).collect())))


# --- robust outliers ----------------------------------------------------------------------------


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    often = collections.Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked)


def brute_distances(rows, groups):
    """Squared distances under the same estimate, in numpy."""
    n = np.maximum(rows[:, 0], 1)
    z = np.log1p(np.stack([rows[:, 0], rows[:, 1] / n, rows[:, 2] * 20 / n, rows[:, 3] * 100 / n, rows[:, 4] * 20 / n], axis=1))
    prior = np.diag(list(robust_outliers.PRIOR.values()))
    weight = robust_outliers.PRIOR_ROWS
    out = np.zeros(len(z))

    def estimate(x, scale):
        cov = ((x.T @ x) / len(x) - np.outer(x.mean(0), x.mean(0))) * scale
        return x.mean(0), (cov * len(x) + prior * weight) / (len(x) + weight) + np.diag(list(robust_outliers.FLOOR.values()))

    def distance(x, mean, cov):
        return ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(axis=1)

    for g in set(groups):
        own = np.array([k == g for k in groups])
        x = z[own]
        rounded = np.floor(x * 64 + 0.5) / 64
        middle = np.median(rounded, axis=0)
        spread = np.median(np.abs(rounded - middle), axis=0) * 1.4826
        fits = [estimate(x, 1.0), (middle, np.diag(spread**2 + np.diag(prior) * 0.1))]
        for k, fit in enumerate(fits):
            for _ in range(robust_outliers.STEPS):
                bins = np.floor(np.log1p(distance(x, *fit)) * robust_outliers.BINS_PER_UNIT)
                edge = np.sort(bins)[math.ceil(len(x) * robust_outliers.SUPPORT) - 1]
                fit = estimate(x[bins <= edge], robust_outliers.CONSISTENCY)
            fits[k] = fit
        best = min(fits, key=lambda f: np.linalg.slogdet(f[1])[1])
        out[own] = distance(x, *best)
    return out


def test_statistics_equal_brute_force(spark):
    found = robust_outliers.text_statistics(cases.frame(spark)).drop("group").collect()
    expected = [(i, *brute_statistics(t)) for i, t in cases.texts()]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
    many = [(i, " ".join(cases.words(60, i, vocabulary=3 + i % 5).split() * (1 + i % 2))) for i in range(80)]
    found = robust_outliers.text_statistics(cases.frame(spark, many)).drop("group").collect()
    assert sorted(map(tuple, found)) == sorted((i, *brute_statistics(t)) for i, t in many)


def test_outliers_equal_numpy_and_are_rejected(spark):
    rows = [(i, cases.words(80 + 7 * (i % 50), i)) for i in range(600)]
    rows += [(1000 + i, cases.words(150, i).replace(" ", " ###$$$%%% ")) for i in range(12)]
    docs = cases.frame(spark, rows)
    found = {r["doc_id"]: r for r in robust_outliers.judge_quality(docs).collect()}
    groups = [([None, "en", "de"][k % 3], [None, "a", "b"][k % 2]) for k in range(len(rows))]
    expected = brute_distances(np.array([brute_statistics(t) for _, t in rows], dtype=float), groups)
    assert np.allclose([found[i]["distance"] for i, _ in rows], expected, rtol=1e-6)
    assert all(found[i]["kept"] for i in range(600)) and not any(found[1000 + i]["kept"] for i in range(12))


def test_odd_rows_fail_the_base_rules_or_get_a_verdict(spark):
    found = robust_outliers.judge_quality(cases.frame(spark)).collect()
    assert len(found) == len(cases.texts())
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert robust_outliers.judge_quality(cases.empty(spark)).collect() == []
    plan = robust_outliers.judge_quality(cases.frame(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    with pytest.raises(ValueError):
        robust_outliers.judge_quality(cases.empty(spark), support=0.2)


# --- context trees ------------------------------------------------------------------------------


def brute_log10(train, text, depth):
    """Probability of a text by the recursive definition, one context tree per decision."""
    counts = collections.defaultdict(lambda: [0, 0])
    for t in train:
        padded = bytes(depth) + t + b"\0"
        for i in range(depth, len(padded)):
            for level in range(8):
                node = 1 << level | padded[i] >> 8 - level
                for d in range(depth + 1):
                    counts[node, padded[i - d : i]][padded[i] >> 7 - level & 1] += 1

    def pe(node, context):
        a, b = counts.get((node, context), (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    seen = collections.defaultdict(set)
    for node, context in list(counts):
        if context:
            seen[node, context[1:]].add(context)

    def pw(node, context):
        if len(context) == depth:
            return pe(node, context)
        return np.logaddexp(pe(node, context), sum(pw(node, c) for c in seen.get((node, context), ()))) - math.log(2)

    def one(node, padded, i, d):
        context = padded[i - d : i]
        a, b = counts.get((node, context), (0, 0))
        own = (b + 0.5) / (a + b + 1)
        if d == depth:
            return own
        leaf = math.exp(pe(node, context) - math.log(2) - pw(node, context))
        return leaf * own + (1 - leaf) * one(node, padded, i, d + 1)

    total, padded = 0.0, bytes(depth) + text + b"\0"
    for i in range(depth, len(padded)):
        for level in range(8):
            p = one(1 << level | padded[i] >> 8 - level, padded, i, 0)
            total += math.log10(p if padded[i] >> 7 - level & 1 else 1 - p)
    return total


def trained(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 != 0


def test_scores_equal_brute_force(spark):
    rows = [(i, t) for i, t in zip(range(1, 40), ["abab", "abc abd", "", None, "Zé ab", "abababab", "bad cab", "a b c"] * 5)] + [(None, "abab")]
    assert 0 < sum(not trained(i) for i, _ in rows)
    train = [(t or "").encode() for i, t in rows if trained(i)]
    tokens = collections.Counter(w for t in train for w in t.lower().split())
    total, distinct = sum(tokens.values()) + len(train), len(tokens) + 1
    known = {t: brute_log10(train, (t or "").encode(), context_tree.DEPTH) for t in {t for _, t in rows}}
    for block_bytes in (12_000_000, 40):
        found = context_tree.score_texts(cases.frame(spark, rows), block_bytes=block_bytes).collect()
        texts = dict(rows)
        assert len(found) == len(rows)
        for r in found:
            text = texts[r["doc_id"]]
            counts = [tokens[w] for w in (text or "").encode().lower().split()] + [len(train)]
            base = sum(math.log10((c + 0.1) / (total + 0.1 * (distinct + 1))) for c in counts)
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not trained(r["doc_id"]), len(counts), sum(c > 0 for c in counts), total)
            assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(known[text], rel=1e-9)


def test_scores_of_odd_rows(spark):
    found = context_tree.score_texts(cases.frame(spark)).collect()
    assert sorted(map(repr, (r["doc_id"] for r in found))) == sorted(map(repr, (i for i, _ in cases.texts())))
    assert all(r["score"] < 0 for r in found)
    assert context_tree.score_texts(cases.empty(spark)).collect() == []
    lone = next(i for i in range(100) if not trained(i))
    only = context_tree.score_texts(cases.frame(spark, [(lone, "abc")])).first()
    assert only["train_tokens"] == 0 and only["base_score"] == 0.0 and only["score"] == pytest.approx(32 * math.log10(0.5))


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.5, 100.0, 1e6])
    assert np.allclose(context_tree.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-10)


# --- secrets ------------------------------------------------------------------------------------


def brute_base(text):
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text):
        found += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_findings_equal_brute_force(spark):
    texts = ["pass" "word: abc", "é TOKEN='abcdef' api-key=zzzzzz apikey:\"a.b/c=d\"", "ſecret=abcdefg toKen=abcdefg", "AKIA" + "A" * 15, "AKIA" + "9" * 16 + "b", "f" * 23 + " " + "f" * 24, "token==aaaaaa", "secret=token=abcdef", "password=\nabcdef"]
    rows = cases.texts() + [(200 + i, t) for i, t in enumerate(texts)]
    found = secret_scan.scan_secrets(cases.frame(spark, rows), None).collect()
    expected = []
    for i, t in rows:
        spans = brute_base(t or "")
        text = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        expected.append((i, *[sum(k == j for _, k, _ in spans) for j in range(3)], hashlib.sha256(text.encode()).hexdigest(), text))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
    assert secret_scan.scan_secrets(cases.empty(spark), None).collect() == []
    assert secret_scan.fit_network(cases.empty(spark)) is None


@pytest.fixture(scope="module")
def prose(spark):
    """Documents with long plain words and a few findings of the patterns."""
    rows = []
    for i in range(400):
        key = hashlib.sha256(str(i).encode()).hexdigest()
        extra = [f' token="{key[:40]}" ', " internationalisationorganisationally ", f" AKIA{key[:16].upper()} ", " straightforwardnesses/unquestionably "][i % 4]
        rows.append((i, cases.words(40, i) + extra + cases.words(40, i + 1000)))
    return rows


@pytest.fixture(scope="module")
def network(spark, prose):
    return secret_scan.fit_network(cases.frame(spark, prose))


def planted(families, each=200, seed=77):
    rng = np.random.default_rng(seed)
    return [(f, secret_scan.draw_key(f, rng)) for f in families for _ in range(each)]


def test_planted_keys_without_a_keyword_are_found(spark, prose, network):
    keys = planted(secret_scan.FAMILIES)
    rows = [(10_000 + i, f"{cases.words(12, i)} {k} {cases.words(12, i + 5000)}") for i, (_, k) in enumerate(keys)]
    found = {r["doc_id"]: r["spans"] for r in secret_scan.scan_secrets(cases.frame(spark, prose + rows), network).collect()}
    missed = dict.fromkeys(secret_scan.FAMILIES, 0)
    for (i, text), (family, key) in zip(rows, keys):
        start = text.index(key)
        missed[family] += f"network:{start}:{start + len(key)}" not in found[i] and not found[i].startswith("hex:")
    assert max(missed.values()) <= 20
    assert sum("network" in found[i] for i, _ in prose) == 0
    assert network.precision >= 0.98


@pytest.mark.parametrize("family", ["letters and digits", "base 32"])
def test_keys_of_a_family_left_out_of_training_are_found(spark, prose, family):
    found = secret_scan.labelled_findings(cases.frame(spark, prose), "doc_id", "text", secret_scan.SAMPLE_FINDINGS)
    assert secret_scan.family_recall(found, family) >= 0.9


def test_found_keys_are_replaced(spark, network):
    hidden = "X7q9Zk2MbV4tR8wLpN3sD6yH1cJ5"
    rows = [(1, f"the key is {hidden} today"), (2, "a word like internationalisationorganisations is fine"), (3, None)]
    clean = {r["doc_id"]: r for r in secret_scan.redact_secrets(cases.frame(spark, rows), network, length_col="n_chars").collect()}
    assert clean[1]["text"] == "the key is [SECRET] today" and clean[1]["n_chars"] == 25
    assert clean[2]["text"] == rows[1][1]


def test_candidates_lie_outside_all_findings():
    rng = np.random.default_rng(8)
    for _ in range(200):
        text = "".join(rng.choice([" ", "a" * 17, "f0" * 13, "AKIA" + "B" * 20, 'token="' + "c" * 20, "=", "longwordoffarmore"]) for _ in range(30))
        spans = secret_scan.base_spans(text)
        free = [m.span() for m in secret_scan.CANDIDATE.finditer(text) if not any(a < m.end() and m.start() < b for a, _, b in spans)]
        assert secret_scan.candidates(text, spans) == free


def test_time_is_linear_in_findings():
    text = ('token="' + "a1b2c3d4e5" * 4 + '" internationalisationorganisations ') * 120_000
    spans = secret_scan.base_spans(text)
    start = time.monotonic()
    assert len(text) > 9_000_000 and len(secret_scan.candidates(text, spans)) == 120_000
    assert time.monotonic() - start < 20


def test_a_key_late_in_a_long_token_is_found():
    class Finder:
        threshold = 0.5

        def probability(self, windows):
            return np.array([float("X7Q9ZK2M" in w) for w in windows])

    path = "plain/words/" * 6
    late = path + "X7Q9ZK2M" + path
    assert secret_scan.find_spans(["see " + late + " there"], Finder()) == [[(4, 3, 4 + len(late))]]
    assert secret_scan.find_spans(["see " + path + " there"], Finder()) == [[]]


def test_threshold_keeps_the_recall_of_rare_findings():
    class Weak(secret_scan.CharNetwork):
        def logits(self, windows):
            return np.array([float(w) for w in windows])

    rng = np.random.default_rng(2)
    labels = np.repeat([1.0, 0.0], [40, 3000])
    windows = [str(z) for z in np.concatenate([rng.normal(1, 1, 40), rng.normal(-1, 1, 3000)])]
    net = secret_scan.calibrate(Weak(*[np.zeros(1)] * 4, 0.0), windows, labels)
    above = net.probability(windows) >= net.threshold
    assert net.threshold < 0.5 and above[:40].mean() >= secret_scan.RECALL
    assert net.precision == labels[above].mean()


def test_rare_findings_of_a_large_table_train_the_network(spark):
    text = F.concat(F.lit("plain words and internationalisation"), F.repeat(F.lit("ab"), (F.col("id") % 9).cast("int")), F.when(F.col("id") % 1500 == 0, F.concat(F.lit(" AKIA"), F.lpad("id", 16, "0"))).otherwise(""))
    found = secret_scan.labelled_findings(spark.range(60_000).select(F.col("id").alias("doc_id"), text.alias("text")), "doc_id", "text", sample_findings=30)
    assert sum(y == 1 for y, _ in found) == 30 and sum(y == 0 for y, _ in found) >= 9


def test_the_network_learns_from_all_findings(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "SAMPLE_FINDINGS", 5)
    monkeypatch.setattr(secret_scan, "WINDOWS_PER_BLOCK", 200)
    seen = {}
    monkeypatch.setattr(secret_scan, "train_on_all", lambda windows, n, share: seen.update(rows=windows.collect(), n=n))
    monkeypatch.setattr(secret_scan, "calibrate_on_all", lambda net, held, recall: seen.update(held=held.collect()))
    texts = [f"{cases.words(30, i)} extraordinarily/{i:05} {cases.words(30, i + 5000)} AKIA{i:016}" for i in range(300)]
    secret_scan.fit_network(cases.frame(spark, list(enumerate(texts))))
    windows = [r["window"] for r in seen["rows"] + seen["held"]]
    for i in range(300):
        assert any(f"AKIA{i:016}" in w[secret_scan.BEFORE :] for w in windows) and any(f"extraordinarily/{i:05}" in w for w in windows)
    assert seen["n"] == len(seen["rows"]) and len({r["block"] for r in seen["rows"]}) > 10


def test_calibration_by_counts_equals_the_sorted_one(spark):
    class Weak(secret_scan.CharNetwork):
        def logits(self, windows):
            return np.array([float(w) for w in windows])

    rng = np.random.default_rng(3)
    labels = np.repeat([1.0, 0.0], [90, 800])
    windows = [str(z) for z in np.round(np.concatenate([rng.normal(1, 1, 90), rng.normal(-1, 1, 800)]), 2)]
    own = secret_scan.calibrate(Weak(*[np.zeros(1)] * 4, 0.0), windows, labels)
    frame = spark.createDataFrame(list(zip(windows, labels.tolist())), "window string, y double")
    net = secret_scan.calibrate_on_all(Weak(*[np.zeros(1)] * 4, 0.0), frame)
    found, expected = ([n.slope, n.shift, n.threshold, n.precision] for n in (net, own))
    assert np.allclose(found, expected, rtol=1e-9)


def test_windows_cover_the_whole_token():
    token = "".join(chr(0x100 + i) for i in range(150))
    for n in (16, 44, 45, 66, 67, 150):
        text = "b" * 30 + token[:n] + "a" * 30
        windows = secret_scan.windows_of(text, 30, 30 + n)
        own = [w[secret_scan.BEFORE : secret_scan.BEFORE + secret_scan.WITHIN] for w in windows]
        assert all(len(w) == secret_scan.WIDTH and w.strip("\0") in text for w in windows if n >= 44)
        assert all(any(token[at : at + 16] in w for w in own) for at in range(n - 15))


# --- quality ------------------------------------------------------------------------------------


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(400, len(quality_gbt.FEATURES)))
    labels = ((rows[:, 0] > 0) ^ (rows[:, 3] > 0.5)).astype(float)
    model = quality_gbt.fit_trees(rows, labels, trees=12, depth=3)
    expected = []
    for row in rows:
        z = model.base
        for t in range(12):
            node = 0
            while node < 7:
                node = 2 * node + (2 if row[model.feature[t, node]] > model.threshold[t, node] else 1)
            z += model.leaf[t, node - 7]
        expected.append(1 / (1 + math.exp(-z)))
    found = model.score(rows)
    assert np.allclose(found, expected) and ((found >= 0.5) == labels).mean() > 0.97
    assert model.score(rows[:0]).shape == (0,)


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    found = queries()["op8_quality_gbt"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = found.where("held_out").join(labels, "doc_id").collect()
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_a_repeated_identifier_counts_once(spark):
    rows = [(i, cases.words(30, i)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    more = rows + [rows[7]] * 500
    once, often = (quality_gbt.fit_quality(cases.frame(spark, r), labels) for r in (rows, more))
    texts = pa.array([t for _, t in rows])
    assert np.array_equal(once.score(quality_gbt.table_of(texts)), often.score(quality_gbt.table_of(texts)))


def test_quality_of_odd_rows(spark):
    docs = cases.frame(spark)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = quality_gbt.fit_quality(docs, none)
    assert {r["score"] for r in quality_gbt.score_quality(docs, model).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (1, 1), (11, 0), (10, 1), (9, 0)], "doc_id long, quality int")
    model = quality_gbt.fit_quality(docs, labels, trees=3, least=0.1)
    scores = quality_gbt.score_quality(docs, model)
    assert scores.count() == len(cases.texts()) and scores.where((F.col("score") < 0) | (F.col("score") > 1)).count() == 0
    kept = quality_gbt.keep_good(docs, model, threshold=0.0)
    assert kept.schema == docs.schema and kept.count() == len(cases.texts())
    assert quality_gbt.score_quality(cases.empty(spark), model).collect() == []
