"""Quality rules: fixed base rules, and robust multivariate outliers per language and source.

Every text gets its statistics in one pass. Their transformed vectors are judged within their group
(language and source) by a minimum covariance determinant estimate: from two deterministic starts
(medians with absolute deviations, and the plain moments) concentration steps take the ``support``
share of rows with the smallest Mahalanobis distances and estimate mean and covariance anew; of the
two, the one with the smaller determinant counts. Rows whose distance under it exceeds ``cutoff``
are rejected.

A step is one aggregation: distances fall into fine bins, sums are taken per group and bin, and a
running count over the few bins of a group says which bins are in. All rows count, no group is
brought into one task, and the parameters reach the rows by a join that is salted, so that a source
with a third of all rows is spread. Covariances are pulled towards a wide fixed one with the weight
of ``PRIOR_ROWS`` rows, which keeps small groups regular, and each variance has ``FLOOR`` added, which
keeps constant statistics of large groups from rejecting texts for the least difference.

Only DataFrame functions are used. Nulls: a null text has no words and fails the base rules; null
languages and sources are groups of their own. Repeated rows are judged each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aestudy.llm.common import WORD_PATTERN
from aestudy.sources.checkpoints import cut_lineage

LEAST_WORDS = 50
REPEAT_PERCENT = 50

SUPPORT = 0.75
STEPS = 5
SALTS = 32
BINS_PER_UNIT = 24
PRIOR_ROWS = 20.0
#: Variances of the fixed covariance, by transformed statistic.
PRIOR = {"z_words": 1.5, "z_length": 0.03, "z_symbols": 1.0, "z_lines": 1.0, "z_repeats": 2.0}
#: Least variances: a passage or line that occurs twice in a text is no outlier, even where no other text has any.
FLOOR = {"z_words": 0.05, "z_length": 0.001, "z_symbols": 0.02, "z_lines": 0.06, "z_repeats": 0.3}
NAMES = list(PRIOR)
#: Squared distance at the 1 - 1e-6 quantile of chi-square with five degrees of freedom.
CUTOFF = 35.9
#: What makes the covariance of the nearest three quarters consistent for a normal distribution in five dimensions.
CONSISTENCY = 1.41

BLANKS = " \t\n\x0b\x0c\r"


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found at least twice, each counted once.

    Windows are sorted by hash with their place in the low bits; neighbours with the same hash are
    compared word by word.
    """
    n = F.size(words)
    bits = F.length(F.bin(n.cast("long"))).cast("int")

    def shift(kind: str, value: Column, by: Column) -> Column:
        return F.call_function(kind, value, by)

    def place(entry: Column) -> Column:
        return entry.bitwiseAND(shift("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")

    def same(a: Column, b: Column) -> Column:
        equal_hash = shift("shiftrightunsigned", a, bits) == shift("shiftrightunsigned", b, bits)
        i, j = place(a), place(b)
        return F.coalesce(equal_hash & reduce(Column.__and__, [F.get(words, i + k) == F.get(words, j + k) for k in range(3)]), F.lit(False))

    hashed = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: shift("shiftleft", F.xxhash64(*[F.get(words, i + k) for k in range(3)]), bits).bitwiseOR(i.cast("long")),
    )
    twice = bound(F.sort_array(hashed), lambda s: F.filter(s, lambda v, k: same(v, F.get(s, k - 1)) | same(v, F.get(s, k + 1))))
    places = F.sort_array(F.transform(twice, place))
    covered = bound(places, lambda p: F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(total)


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, group, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    group = F.to_json(F.struct(F.col(lang_col).alias("l"), F.col(source_col).alias("s")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), group.alias("group"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0)))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    return rows.select(
        "doc_id",
        "group",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)


def transformed() -> list[Column]:
    """The statistic vector: sizes on a log scale, rates per word on a log scale."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(F.col("n_words").cast("double")).alias("z_words"),
        F.log1p(F.col("word_chars") / n).alias("z_length"),
        F.log1p(F.col("n_symbols") * 20 / n).alias("z_symbols"),
        F.log1p(F.col("n_dup_lines") * 100 / n).alias("z_lines"),
        F.log1p(F.col("n_repeat_words") * 20 / n).alias("z_repeats"),
    ]


def pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]


def with_factor(moments: DataFrame, scale: float) -> DataFrame:
    """From n, s<i>, q<i>_<j> per group and start: mean m<i>, Cholesky factor c<i>_<j> and log determinant."""
    df = moments.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(len(NAMES))})
    cov = {}
    for i, j in pairs():
        own = (F.col(f"q{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * F.lit(scale)
        prior = PRIOR[NAMES[i]] * PRIOR_ROWS if i == j else 0.0
        floor = FLOOR[NAMES[i]] if i == j else 0.0
        cov[f"v{i}_{j}"] = (own * F.col("n") + F.lit(prior)) / (F.col("n") + PRIOR_ROWS) + F.lit(floor)
    df = df.withColumns(cov)
    for j in range(len(NAMES)):
        taken = [F.col(f"c{j}_{k}") * F.col(f"c{j}_{k}") for k in range(j)]
        pivot = reduce(lambda a, b: a - b, taken, F.col(f"v{j}_{j}"))
        df = df.withColumn(f"c{j}_{j}", F.sqrt(F.greatest(pivot, F.lit(1e-9))))
        below = {}
        for i in range(j + 1, len(NAMES)):
            taken = [F.col(f"c{i}_{k}") * F.col(f"c{j}_{k}") for k in range(j)]
            below[f"c{i}_{j}"] = reduce(lambda a, b: a - b, taken, F.col(f"v{i}_{j}")) / F.col(f"c{j}_{j}")
        if below:
            df = df.withColumns(below)
    logs = [F.log(f"c{i}_{i}") for i in range(len(NAMES))]
    return df.select("group", "start", *PARAMETERS, reduce(Column.__add__, logs).alias("log_det"))


PARAMETERS = [f"m{i}" for i in range(len(NAMES))] + [f"c{i}_{j}" for i, j in pairs()]


def with_distance(rows: DataFrame, parameters: DataFrame) -> DataFrame:
    """Rows joined with their group's parameters, one row per start, with the squared distance ``d2``."""
    spread = parameters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    df = rows.join(spread, ["group", "salt"])
    for i, name in enumerate(NAMES):
        taken = [F.col(f"c{i}_{k}") * F.col(f"y{k}") for k in range(i)]
        df = df.withColumn(f"y{i}", reduce(lambda a, b: a - b, taken, F.col(name) - F.col(f"m{i}")) / F.col(f"c{i}_{i}"))
    return df.withColumn("d2", reduce(Column.__add__, [F.col(f"y{i}") * F.col(f"y{i}") for i in range(len(NAMES))]))


def sums() -> list[Column]:
    first = [F.sum(name).alias(f"s{i}") for i, name in enumerate(NAMES)]
    second = [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"q{i}_{j}") for i, j in pairs()]
    return [F.count(F.lit(1)).alias("n"), *first, *second]


def starts(rows: DataFrame) -> DataFrame:
    """Parameters of the two starts of every group."""
    plain = with_factor(rows.groupBy("group").agg(*sums()).withColumn("start", F.lit(0)), 1.0)
    # Rounded values have few distinct ones, so that exact medians need little memory.
    rounded = [F.round(F.col(name) * 64) / 64 for name in NAMES]
    middle = rows.groupBy("group").agg(*[F.percentile(r, 0.5).alias(f"m{i}") for i, r in enumerate(rounded)])
    spread = middle.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    away = [F.percentile(F.abs(r - F.col(f"m{i}")), 0.5).alias(f"a{i}") for i, r in enumerate(rounded)]
    same = [F.first(f"m{i}").alias(f"m{i}") for i in range(len(NAMES))]
    robust = rows.join(spread, ["group", "salt"]).groupBy("group").agg(*away, *same)
    factor = {}
    for i, j in pairs():
        wide = F.sqrt(F.pow(F.col(f"a{i}") * 1.4826, 2) + PRIOR[NAMES[i]] * 0.1)
        factor[f"c{i}_{j}"] = wide if i == j else F.lit(0.0)
    robust = robust.withColumns(factor | {"start": F.lit(1), "log_det": F.lit(0.0)})
    return plain.unionByName(robust.select(plain.columns))


def concentrated(rows: DataFrame, parameters: DataFrame, support: float) -> DataFrame:
    """One concentration step for every group and start."""
    near = with_distance(rows, parameters).withColumn("bin", F.floor(F.log1p("d2") * BINS_PER_UNIT))
    binned = near.groupBy("group", "start", "bin").agg(*sums())
    own = Window.partitionBy("group", "start")
    before = F.coalesce(F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = binned.withColumns({"before": before, "rows": F.sum("n").over(own)}).where(F.col("before") < F.ceil(F.col("rows") * support))
    names = ["n", *(f"s{i}" for i in range(len(NAMES))), *(f"q{i}_{j}" for i, j in pairs())]
    return with_factor(inside.groupBy("group", "start").agg(*[F.sum(c).alias(c) for c in names]), CONSISTENCY)


def judge_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    support: float = SUPPORT,
    cutoff: float = CUTOFF,
    steps: int = STEPS,
) -> DataFrame:
    """doc_id, the statistics, base_failed, distance (squared) and kept, one row per row of ``docs``."""
    if not 0.5 <= support < 1 or steps < 1:
        raise ValueError("support lies in [0.5, 1), and at least one step is taken")
    stats = text_statistics(docs, id_col, text_col, lang_col, source_col)
    rows = cut_lineage(stats.select("*", *transformed(), F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int").alias("salt")))
    parameters = cut_lineage(starts(rows))
    for _ in range(steps):
        parameters = cut_lineage(concentrated(rows, parameters, support))
    chosen = parameters.groupBy("group").agg(F.min_by(F.struct(*PARAMETERS, "start"), F.struct("log_det", "start")).alias("p")).select("group", "p.*")
    judged = with_distance(rows, chosen).withColumn("base_failed", base_failed())
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("d2") <= cutoff)).alias("kept"),
        F.col("d2").alias("distance"),
    )
