"""Breaking a fitted regression into multiplicative factor tables.

Every coefficient belongs to a term group. A group's factor is ``exp`` of the part of the linear
predictor that its coefficients make up, tabulated over all values of its variables; the product of
all factors is the model's prediction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aestudy.operators.checks import duplicate_keys, require_columns
from aestudy.operators.design import Design, DesignColumn, term_name, term_variables
from aestudy.operators.glm import INTERCEPT, GLMPath
from aestudy.operators.grid import grid_axes, occurring_combinations, prediction_grid
from aestudy.operators.lookup import BROADCAST_BYTES, lookup, unique_key_profiles, unmatched_keys
from aestudy.operators.study import all_close
from aestudy.sources.checkpoints import cut_lineage

VALUE_TOLERANCE = 1e-12
PRODUCT_TOLERANCE = 1e-10
#: Terms that an error names, beside the number of all.
SHOWN_TERMS = 20


def variable_order(design: Design) -> dict[str, int]:
    """Place of each variable: that of its own main effect, else of the first term with it."""
    order: dict[str, int] = {}
    for wanted in (lambda n: n == 1, lambda n: n > 1):
        for place, term in enumerate(design.terms):
            variables = term_variables(term)
            if wanted(len(variables)):
                for v in variables:
                    order.setdefault(v, place)
    return order


def ordered_variables(design: Design, variables: Sequence[str]) -> list[str]:
    order = variable_order(design)
    return sorted(dict.fromkeys(variables), key=lambda v: order[v])


def default_groups(design: Design) -> dict[str, list[str]]:
    """Term names per group, intercept first.

    The widest interactions come first and claim every free term within their variables; what is
    left is grouped by its own variables.
    """
    members = {term_name(t): term_variables(t) for t in design.terms}
    groups: dict[str, list[str]] = {INTERCEPT: [INTERCEPT]}
    free = list(members)
    wide = sorted((t for t in members if len(members[t]) > 1), key=lambda t: -len(members[t]))
    for leader in wide + list(members):
        if leader not in free:
            continue
        reach = set(members[leader])
        claimed = [t for t in free if set(members[t]) <= reach] if len(reach) > 1 else [leader]
        name = "_x_".join(ordered_variables(design, members[leader])) or leader
        groups.setdefault(name, []).extend(claimed)
        free = [t for t in free if t not in claimed]
    return groups


class FactorAnalysis:
    """Factor map, factor tables and factor predictions of a model at one penalty."""

    def __init__(self, spark: SparkSession, model: GLMPath, alpha_index: int = -1):
        self.spark = spark
        self.model = model
        self.design = model.design
        self.alpha_index = model.index(alpha_index)
        self.coefficients = model.by_name(alpha_index)
        self._column = {c.name: c for c in self.design.columns}
        group_of_term = {t: g for g, terms in default_groups(self.design).items() for t in terms}
        self._group_of = {t: group_of_term[self._term_of(t)] for t in self.coefficients}

    def _term_of(self, column: str) -> str:
        return column if column == INTERCEPT else self._column[column].term

    def coefficient_terms(self) -> DataFrame:
        """``(pos, term, term_value, model_term)`` in coefficient order."""
        rows = [(i, t, v, self._term_of(t)) for i, (t, v) in enumerate(self.coefficients.items())]
        return self.spark.createDataFrame(rows, "pos int, term string, term_value double, model_term string")

    def factor_map(self) -> DataFrame:
        """``(term, term_value, model_term, term_group)`` in coefficient order."""
        rows = [(t, v, self._term_of(t), self._group_of[t]) for t, v in self.coefficients.items()]
        return self.spark.createDataFrame(
            rows, "term string, term_value double, model_term string, term_group string"
        )

    def set_factor_map(self, factor_map: DataFrame) -> None:
        """Take over the user's groups after checking that the map covers the coefficients exactly."""
        normal = normalize_factor_map(factor_map, self.coefficient_terms())
        self._group_of = {r["term"]: r["term_group"] for r in normal.collect()}

    @property
    def groups(self) -> dict[str, list[str]]:
        """Coefficient names per group, groups in order of their first coefficient."""
        out: dict[str, list[str]] = {}
        for term in self.coefficients:
            out.setdefault(self._group_of[term], []).append(term)
        return out

    def group_variables(self, group: str) -> list[str]:
        used = [v for t in self.groups[group] if t != INTERCEPT for v in self._column[t].variables]
        return ordered_variables(self.design, used)

    def factor_tables(self, train: DataFrame, max_rows: int | None = None) -> dict[str, DataFrame]:
        """One table ``(variables..., factor, term_group)`` per group.

        Values come from ``train``: all integers of a numeric variable's range, and the levels that
        occur. A group without variables, such as the intercept's, has one row.
        """
        axes = grid_axes(train, self.model.input_cols)
        return {
            group: self._factors_on(group, prediction_grid(self.spark, [axes[v] for v in self.group_variables(group)], max_rows))
            for group in self.groups
        }

    def occurring_factor_tables(self, df: DataFrame) -> dict[str, DataFrame]:
        """The same tables over the combinations that occur in ``df`` only.

        A group of several variables with wide ranges has as many rows as ``df`` has combinations, not as
        many as the product of the ranges. Numbers need not be whole here.
        """
        keyed = [g for g in self.groups if self.group_variables(g)]
        found = occurring_combinations(df, [self.group_variables(g) for g in keyed]) if keyed else []
        rows = dict(zip(keyed, found))
        return {g: self._factors_on(g, rows[g] if g in rows else prediction_grid(self.spark, [])) for g in self.groups}

    def _factors_on(self, group: str, combinations: DataFrame) -> DataFrame:
        terms = self.groups[group]
        columns: list[DesignColumn] = [self._column[t] for t in terms if t != INTERCEPT]
        score = self.design.linear_predictor(self.coefficients, columns)
        if INTERCEPT in terms:
            score = score + F.lit(self.coefficients[INTERCEPT])
        return self.design.with_basis(combinations, columns).select(
            *self.group_variables(group), F.exp(score).alias("factor"), F.lit(group).alias("term_group")
        )

    def append_factors(
        self,
        df: DataFrame,
        tables: dict[str, DataFrame],
        output: str = "model_pred",
        strict: bool = True,
        broadcast_bytes: int = BROADCAST_BYTES,
    ) -> DataFrame:
        """Join every factor table as ``factor_<group>`` and multiply the factors.

        A row without an entry in some table raises, or without ``strict`` counts that factor as 1.
        """
        return join_factors(df, tables, output, strict, broadcast_bytes)

    def predict_by_factors(self, df: DataFrame, output: str = "model_pred") -> DataFrame:
        """Factors and their product for ``df``, from tables over the combinations that occur in ``df`` itself."""
        return self.append_factors(df, self.occurring_factor_tables(df), output)

    def reconstructs(self, df: DataFrame, tables: dict[str, DataFrame], tolerance: float = PRODUCT_TOLERANCE) -> bool:
        """Whether the product of factors equals the direct prediction on every row."""
        both = self.append_factors(self.model.predict(df, self.alpha_index, output="__direct"), tables, "__product")
        return all_close(both, "__product", "__direct", tolerance, tolerance)

    def check(self, df: DataFrame, tables: dict[str, DataFrame], tolerance: float = PRODUCT_TOLERANCE) -> None:
        if not self.reconstructs(df, tables, tolerance):
            raise ValueError("the product of the factors does not match the model's predictions")


def normalize_factor_map(factor_map: DataFrame, terms: DataFrame) -> DataFrame:
    """Check a factor map against ``(pos, term, term_value, model_term)`` and put it in that order."""
    require_columns(factor_map.columns, ["term", "term_group"])
    given = factor_map.withColumns(
        {"term": F.col("term").cast("string"), "term_group": F.col("term_group").cast("string")}
    )
    _refuse(duplicate_keys(given, ["term"]).select("term"), "are given more than once (duplicate)")
    stray = unmatched_keys(terms, given, "term")
    _refuse(stray.where("side = 'missing'").select("term"), "of the model are missing from the map")
    _refuse(stray.where("side = 'unexpected'").select("term"), "of the map are unexpected: the model has no such terms")
    if "term_value" in given.columns:
        _refuse(wrong_values(given, terms).select("term"), "have another term_value than the fitted one")
    return (
        given.select("term", "term_group")
        .join(terms, "term")
        .orderBy("pos")
        .select("term", "term_value", "model_term", "term_group")
    )


def _refuse(terms: DataFrame, what: str) -> None:
    """Raise if there are any terms, with their number and the first few."""
    first = [r["term"] for r in terms.orderBy("term").limit(SHOWN_TERMS).collect()]
    if first:
        raise ValueError(f"{terms.count()} terms {what}, the first are {first}")


def wrong_values(given: DataFrame, terms: DataFrame, tolerance: float = VALUE_TOLERANCE) -> DataFrame:
    """Terms whose given value is missing or not the fitted one."""
    fitted = terms.select("term", F.col("term_value").alias("fitted_value"))
    apart = F.abs(F.col("term_value") - F.col("fitted_value"))
    off = apart > tolerance + tolerance * F.abs(F.col("fitted_value"))
    return given.select("term", "term_value").join(fitted, "term").filter(F.coalesce(off, F.lit(True)))


def group_members(factor_map: DataFrame) -> DataFrame:
    """Sorted distinct model terms per group."""
    return factor_map.groupBy("term_group").agg(F.array_sort(F.collect_set("model_term")).alias("model_terms"))


def long_factors(tables: dict[str, DataFrame]) -> DataFrame:
    """All factor tables in one; variables a group does not have are NULL."""
    out = None
    for table in tables.values():
        out = table if out is None else out.unionByName(table, allowMissingColumns=True)
    return out


def join_factors(
    df: DataFrame,
    tables: dict[str, DataFrame],
    output: str = "model_pred",
    strict: bool = True,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join factor tables by their variables and multiply; see ``FactorAnalysis.append_factors``."""
    keys = {g: [c for c in t.columns if c not in ("factor", "term_group")] for g, t in tables.items()}
    keyed = [g for g in tables if keys[g]]
    require_columns(df.columns, [k for g in keyed for k in keys[g]])
    tables = {g: cut_lineage(t) if g in keyed else t for g, t in tables.items()}
    profiles = dict(zip(keyed, unique_key_profiles([(tables[g], keys[g]) for g in keyed])))
    names = []
    for group, table in tables.items():
        name = f"factor_{group}"
        if group in profiles:
            df = lookup(df, table, keys[group], "factor", name, profiles[group], broadcast_bytes)
        else:
            df = df.withColumn(name, F.lit(_single_factor(table)))
        names.append(name)
    product = F.lit(1.0)
    for name in names:
        factor = F.col("`" + name + "`")
        missing = F.raise_error(F.lit(f"no {name} for a row")).cast("double") if strict else F.lit(1.0)
        product = product * F.coalesce(factor, missing)
    return df.withColumn(output, product)


def _single_factor(table: DataFrame) -> float:
    rows = table.select("factor").limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a factor table without variables must have one row")
    return float(rows[0]["factor"])
