"""Best binary splits of many tree nodes at once, from per-value sums.

A level of a tree is one aggregate: every row adds its gradient and Hessian to one entry per
feature, entries are summed map-side before the shuffle, and running sums over the sorted values
give the gain of each cut. The entries are dealt by ranges of (node, feature, value), and a range
starts from the totals of those before it, so a feature may have any number of values. Numbers split
at midpoints, strings one level against the rest, and a missing number is tried on both sides.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aestudy.functions import text
from aestudy.operators.checks import split_schema
from aestudy.operators.encode import indicator_name
from aestudy.sources.checkpoints import cut_lineage

# Defaults of the Poisson tree objective.
MAX_DELTA_STEP = 0.7
REG_LAMBDA = 1.0
MIN_CHILD_WEIGHT = 1.0
MIN_GAIN = 1e-6


@dataclass(frozen=True)
class SplitRules:
    reg_lambda: float = REG_LAMBDA
    gamma: float = 0.0
    min_child_weight: float = MIN_CHILD_WEIGHT
    max_delta_step: float = MAX_DELTA_STEP

    def gain(self, g: str, h: str) -> str:
        """Drop of the second-order loss when the group takes its own weight, as SQL text.

        With the weight's size ``w = min(|g| / (h + lambda), step limit)`` it is
        ``w (2 |g| - (h + lambda) w)``, which is ``g^2 / (h + lambda)`` below the limit.
        """
        size, total = f"abs({g})", f"({h} + {text.number(self.reg_lambda)})"
        if not self.max_delta_step:
            return f"{size} * {size} / {total}"
        weight = f"least({size} / {total}, {text.number(self.max_delta_step)})"
        return f"{weight} * (2D * {size} - {total} * {weight})"

    def leaf_weight(self, g: float, h: float) -> float:
        raw = -g / (h + self.reg_lambda)
        if not self.max_delta_step:
            return raw
        return max(-self.max_delta_step, min(self.max_delta_step, raw))


@dataclass(frozen=True)
class Features:
    """Feature columns of a tree, with what has to be known about their values beforehand.

    ``first_levels`` are the levels without an indicator. ``binned`` numbers hold the lower end of their
    bin and are cut at the next bin's lower end instead of the midpoint.
    """

    numbers: list[str]
    strings: list[str]
    first_levels: dict[str, str | None] = field(default_factory=dict)
    binned: list[str] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return self.numbers + self.strings


def number_value(column: str) -> Column:
    value = F.col("`" + column + "`").cast("double")
    return F.nanvl(value, F.lit(None).cast("double"))


def describe_features(df: DataFrame, response: Sequence[str]) -> Features:
    """Split the columns by type; one pass finds the first level of every string, if there are any."""
    split = split_schema(df, response)
    if not split.numbers and not split.strings:
        raise ValueError("there is no feature column")
    first_levels = {}
    if split.strings:
        row = df.agg(*[F.min("`" + c + "`").alias(f"first{i}") for i, c in enumerate(split.strings)]).first()
        first_levels = {c: row[f"first{i}"] for i, c in enumerate(split.strings)}
    return Features(numbers=split.numbers, strings=split.strings, first_levels=first_levels)


def value_sums(
    df: DataFrame, features: Features, node: str, open_nodes: Sequence[int], g: str, h: str
) -> DataFrame:
    """Gradient and Hessian per node, feature and value; rows outside ``open_nodes`` take no part.

    ``node``, ``g`` and ``h`` are SQL text over the columns of ``df``.
    """
    entries = []
    for c in features.numbers:
        value = f"nanvl(CAST({text.name(c)} AS DOUBLE), CAST(NULL AS DOUBLE))"
        entries.append((c, "false", value, text.string(None)))
    for c in features.strings:
        entries.append((c, "true", "CAST(NULL AS DOUBLE)", text.name(c)))
    structs = ", ".join(
        f"named_struct('feature', {text.string(c)}, 'is_level', {is_level}, 'value', {value}, 'level', {level})"
        for c, is_level, value, level in entries
    )
    return (
        df.selectExpr("*", f"{node} AS __node")
        .where(f"__node IN ({', '.join(map(str, open_nodes))})")
        .selectExpr("__node AS nodeid", f"{g} AS g", f"{h} AS h", f"inline(array({structs}))")
        .groupBy("nodeid", "feature", "is_level", "value", "level")
        .agg(F.expr("sum(g) AS g"), F.expr("sum(h) AS h"), F.expr("count(1) AS n"))
    )


PRESENT = "CASE WHEN value IS NOT NULL THEN {0} ELSE 0 END"
MISSING = "CASE WHEN value IS NULL AND NOT is_level THEN {0} ELSE 0 END"
UP_TO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
WHOLE = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


def with_running_sums(sums: DataFrame) -> DataFrame:
    """Add running sums over the sorted values, the next value, node totals and missing totals.

    Entries are sorted by ranges of (node, feature, value, level). They are written down once, because
    the ranges must stay the same for the totals and for the running sums inside. A table of at most one row
    per range, node and feature says where each range starts; that bounds the broadcast.
    """
    ranges = sums.repartitionByRange("nodeid", "feature", "value", "level")
    ordered = cut_lineage(ranges.withColumn("part", F.spark_partition_id()))
    by_part = "PARTITION BY nodeid, feature ORDER BY part"
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    after = "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"
    per_part = ordered.groupBy("nodeid", "feature", "part").agg(
        F.expr(f"sum({PRESENT.format('g')}) AS p_g"),
        F.expr(f"sum({PRESENT.format('h')}) AS p_h"),
        F.expr("sum(g) AS all_g"),
        F.expr("sum(h) AS all_h"),
        F.expr(f"sum({MISSING.format('g')}) AS m_g"),
        F.expr(f"sum({MISSING.format('h')}) AS m_h"),
        F.expr(f"sum({MISSING.format('n')}) AS m_n"),
        F.expr("min(value) AS first_value"),
    )
    starts = per_part.selectExpr(
        *["nodeid", "feature", "part"],
        f"coalesce(sum(p_g) OVER ({by_part} {before}), 0) AS off_g",
        f"coalesce(sum(p_h) OVER ({by_part} {before}), 0) AS off_h",
        f"min(first_value) OVER ({by_part} {after}) AS after_part",
        f"sum(all_g) OVER ({by_part} {WHOLE}) AS tot_g",
        f"sum(all_h) OVER ({by_part} {WHOLE}) AS tot_h",
        f"sum(m_g) OVER ({by_part} {WHOLE}) AS miss_g",
        f"sum(m_h) OVER ({by_part} {WHOLE}) AS miss_h",
        f"sum(m_n) OVER ({by_part} {WHOLE}) AS miss_n",
    )
    inside = "PARTITION BY nodeid, feature, part ORDER BY value"
    started = ordered.selectExpr(
        "*",
        f"sum({PRESENT.format('g')}) OVER ({inside} {UP_TO}) AS in_g",
        f"sum({PRESENT.format('h')}) OVER ({inside} {UP_TO}) AS in_h",
        f"lead(value) OVER ({inside}) AS in_next",
    )
    return started.join(F.broadcast(starts), ["nodeid", "feature", "part"]).selectExpr(
        "*", "in_g + off_g AS run_g", "in_h + off_h AS run_h", "coalesce(in_next, after_part) AS next_value"
    )


def split_candidates(sums: DataFrame, features: Features, rules: SplitRules) -> DataFrame:
    """Every admissible cut ``(nodeid, feature, level, threshold, gain, missing_right, g/h per side)``.

    ``feature < threshold`` goes left. An indicator is cut at 0.5, so its level goes right. With
    missing values both sides are tried for them, and also all values against the missing ones.
    """
    is_first = " OR ".join(
        f"(feature = {text.string(c)} AND level <=> {text.string(v)})" for c, v in features.first_levels.items()
    )
    middle = "(value + next_value) / 2"
    # Next to an infinite value, or where the middle rounds to the lower value, the upper one is the cut.
    between = f"CASE WHEN {middle} > value AND {middle} <= next_value THEN {middle} ELSE next_value END"
    if features.binned:
        between = f"CASE WHEN feature IN {text.strings(features.binned)} THEN next_value ELSE {between} END"
    with_missing, inner = "miss_n > 0", "next_value IS NOT NULL"

    def side(missing_right: str, g: str, h: str) -> str:
        return f"named_struct('missing_right', {missing_right}, 'left_g', {g}, 'left_h', {h})"

    rest = side("false", "tot_g - g", "tot_h - h")
    to_left = side("false", "run_g + miss_g", "run_h + miss_h")
    to_right = side("true", "run_g", "run_h")
    right_g, right_h = "tot_g - left_g", "tot_h - left_h"
    gain = f"{rules.gain('left_g', 'left_h')} + {rules.gain(right_g, right_h)} - {rules.gain('tot_g', 'tot_h')}"
    return (
        with_running_sums(sums)
        .where(f"CASE WHEN is_level THEN NOT ({is_first or 'false'}) ELSE value IS NOT NULL AND ({inner} OR {with_missing}) END")
        .selectExpr(
            *["nodeid", "feature", "is_level", "level", "tot_g", "tot_h"],
            f"CASE WHEN is_level THEN 0.5D WHEN {inner} THEN {between} "
            f"ELSE value + abs(value) + {text.number(MIN_GAIN)} END AS threshold",
            f"inline(CASE WHEN is_level THEN array({rest}) WHEN {inner} AND {with_missing} THEN array({to_left}, {to_right}) "
            f"WHEN {inner} THEN array({to_left}) ELSE array({to_right}) END)",
        )
        .selectExpr("*", f"{right_g} AS right_g", f"{right_h} AS right_h", f"{gain} AS gain")
        .where(
            f"least(left_h, right_h) >= {text.number(rules.min_child_weight)} "
            f"AND gain > {text.number(MIN_GAIN)} AND gain >= {text.number(rules.gamma)}"
        )
    )


RANKED = (
    "min(named_struct('loss', -gain, 'feature', feature, 'level', level, 'threshold', threshold, "
    "'missing_right', missing_right, 'is_level', is_level, 'tot_g', tot_g, 'tot_h', tot_h, "
    "'left_g', left_g, 'left_h', left_h, 'right_g', right_g, 'right_h', right_h)) AS s"
)


def best_splits(candidates: DataFrame, per_feature: bool = False) -> DataFrame:
    """The cut with the largest gain per node; ties go to feature, level and threshold in order.

    With ``per_feature`` every feature of a node keeps its best cut. Tasks keep the best of their own ranges
    first, so one row per range, node and feature is shuffled.
    """
    keys = ["nodeid", "feature"] if per_feature else ["nodeid"]
    return candidates.groupBy(*keys).agg(F.expr(RANKED)).selectExpr("nodeid", "-s.loss AS gain", "s.*").drop("loss")


def split_feature_name(feature: str, is_level: bool, level: str | None) -> str:
    """Name of the encoded column a split is on."""
    return indicator_name(feature, level) if is_level else feature
