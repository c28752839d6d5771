"""Model terms and the design columns they stand for.

A model is a list of terms; a term is a tuple of components (a category, a spline, a number), and
``cross`` gives all main effects and products of its arguments. Fitting a design learns levels and
knots from training data once; the same state then encodes any other rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aestudy.functions.spline import basis_columns
from aestudy.operators.checks import require_columns, require_strings
from aestudy.operators.values import baseline_first, distinct_quantiles, levels_of


@dataclass(frozen=True)
class Cat:
    """A string column; the baseline level (the first sorted one if not given) has no own effect."""

    var: str
    baseline: str | None = None

    @property
    def label(self) -> str:
        return self.var


@dataclass(frozen=True)
class Spline:
    """A natural cubic regression spline with ``df`` basis columns between two bounds."""

    var: str
    df: int = 4
    lower: float = 18
    upper: float = 90

    @property
    def label(self) -> str:
        return f"cr({self.var}, df={self.df}, lower_bound={self.lower:g}, upper_bound={self.upper:g})"


@dataclass(frozen=True)
class Num:
    """A numeric column as it is."""

    var: str

    @property
    def label(self) -> str:
        return self.var


Component = Cat | Spline | Num
Term = tuple[Component, ...]


def cross(*components: Component) -> list[Term]:
    """Main effects and all products up to full order."""
    return [t for size in range(1, len(components) + 1) for t in combinations(components, size)]


def term_name(term: Term) -> str:
    return ":".join(c.label for c in term)


def term_variables(term: Term) -> list[str]:
    return list(dict.fromkeys(c.var for c in term))


def order_terms(terms: Iterable[Term]) -> list[Term]:
    """Distinct terms, those with fewer components first, otherwise as written."""
    distinct: dict[frozenset[Component], Term] = {}
    for term in terms:
        distinct.setdefault(frozenset(term), tuple(dict.fromkeys(term)))
    return sorted(distinct.values(), key=len)


@dataclass(frozen=True)
class Atom:
    """One encoded column of a component: a level's indicator, a basis function, or the number."""

    component: Component
    name: str
    level: str | None = None
    basis: int | None = None

    @property
    def slot(self) -> str | None:
        """Name of the working column that holds a basis function."""
        return None if self.basis is None else f"__{self.component.label}_{self.basis}"


@dataclass(frozen=True)
class DesignColumn:
    name: str
    term: str
    variables: tuple[str, ...]
    atoms: tuple[Atom, ...]


@dataclass
class Design:
    """Terms with the levels and knots learned from training data."""

    terms: list[Term]
    levels: dict[str, list[str]] = field(default_factory=dict)
    knots: dict[str, list[float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.columns = self._expand()

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(c.var for t in self.terms for c in t))

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    def _expand(self) -> list[DesignColumn]:
        """Columns of every term.

        The model's intercept is fitted apart from the design, so the first categorical main effect
        keeps all its levels. Elsewhere a category drops its baseline where the rest of its term is
        in the model too.
        """
        present = {frozenset(t) for t in self.terms}
        constant_spanned = False
        columns = []
        for term in self.terms:
            per_component = []
            for component in term:
                rest = frozenset(term) - {component}
                reduced = (rest in present) if rest else constant_spanned
                per_component.append(self._atoms(component, reduced))
            if len(term) == 1 and isinstance(term[0], Cat):
                constant_spanned = True
            for last_first in product(*reversed(per_component)):
                atoms = tuple(reversed(last_first))
                columns.append(
                    DesignColumn(
                        name=":".join(a.name for a in atoms),
                        term=term_name(term),
                        variables=tuple(term_variables(term)),
                        atoms=atoms,
                    )
                )
        return columns

    def _atoms(self, component: Component, reduced: bool) -> list[Atom]:
        if isinstance(component, Num):
            return [Atom(component, component.label)]
        if isinstance(component, Spline):
            return [Atom(component, f"{component.label}[{i + 1}]", basis=i) for i in range(component.df)]
        levels = self.levels[component.var]
        if reduced:
            return [Atom(component, f"{component.var}[T.{v}]", level=v) for v in levels[1:]]
        return [Atom(component, f"{component.var}[{v}]", level=v) for v in levels]

    def with_basis(self, df: DataFrame, columns: Sequence[DesignColumn] | None = None) -> DataFrame:
        """Add the working columns of the splines that ``columns`` use.

        They come in a projection of their own, so that each is evaluated once per row.
        """
        used = {a.component for c in (self.columns if columns is None else columns) for a in c.atoms}
        working: dict[str, Column] = {}
        for component in used:
            if isinstance(component, Spline):
                basis = basis_columns(F.col(component.var), self.knots[component.label])
                for i, b in enumerate(basis):
                    working[Atom(component, "", basis=i).slot] = b
        return df.withColumns(working) if working else df

    def feature(self, column: DesignColumn) -> Column:
        """A design column over the output of ``with_basis``; NULL if one of its variables is."""
        value = None
        for atom in column.atoms:
            part = _atom_value(atom)
            value = part if value is None else value * part
        return value

    def linear_predictor(self, coefficients: dict[str, float], columns: Sequence[DesignColumn] | None = None) -> Column:
        """Weighted sum of design columns over the output of ``with_basis``.

        Columns are gathered by their numeric part: a spline function or number is multiplied once
        by the sum of the coefficients whose levels the row has.
        """
        columns = self.columns if columns is None else list(columns)
        by_numeric: dict[tuple[Atom, ...], list[tuple[tuple[Atom, ...], float]]] = {}
        for column in columns:
            numeric = tuple(a for a in column.atoms if a.level is None)
            levels = tuple(a for a in column.atoms if a.level is not None)
            by_numeric.setdefault(numeric, []).append((levels, float(coefficients[column.name])))
        total = None
        for numeric, entries in by_numeric.items():
            weight = None
            for levels, coefficient in entries:
                part = F.lit(coefficient)
                if levels:
                    has_levels = _all([F.col(a.component.var) == F.lit(a.level) for a in levels])
                    part = F.when(has_levels, part).otherwise(F.lit(0.0))
                weight = part if weight is None else weight + part
            for atom in numeric:
                weight = weight * _atom_value(atom)
            total = weight if total is None else total + weight
        if total is None:
            return F.lit(0.0)
        variables = list(dict.fromkeys(v for c in columns for v in c.variables))
        return F.when(_all([F.col(v).isNotNull() for v in variables]), total)


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out & condition
    return out


def _atom_value(atom: Atom) -> Column:
    if atom.level is not None:
        return (F.col(atom.component.var) == F.lit(atom.level)).cast("double")
    if atom.basis is not None:
        return F.col("`" + atom.slot + "`")
    return F.col(atom.component.var).cast("double")


def fit_design(df: DataFrame, terms: Iterable[Term]) -> Design:
    """Learn category levels and spline knots from training rows or cells."""
    terms = order_terms(terms)
    components = list(dict.fromkeys(c for t in terms for c in t))
    require_columns(df.columns, [c.var for c in components])
    require_strings(df, [c.var for c in components if isinstance(c, Cat)])
    cats = [c for c in components if isinstance(c, Cat)]
    found = levels_of(df, list(dict.fromkeys(c.var for c in cats)))
    levels = {c.var: baseline_first(found[c.var], c.baseline) for c in cats}
    knots: dict[str, list[float]] = {}
    for component in components:
        if isinstance(component, Spline):
            inner = component.df - 2
            probabilities = [(i + 1) / (inner + 1) for i in range(inner)]
            at = distinct_quantiles(df, component.var, probabilities, component.lower, component.upper) if inner else []
            knots[component.label] = [float(component.lower), *at, float(component.upper)]
    return Design(terms, levels, knots)
