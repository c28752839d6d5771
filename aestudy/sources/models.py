"""Model state as small parquet tables, and models read back from them."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from aestudy.operators.boost import BoostModel
from aestudy.operators.design import Cat, Component, Design, Num, Spline
from aestudy.operators.encode import EncodedColumn
from aestudy.operators.glm import GLMPath
from aestudy.operators.tree import NODE_SCHEMA, Node, Tree
from aestudy.sources.tables import append_records, overwrite_parquet, sample_input, scoring_schema

TERMS_SCHEMA = (
    "term int, place int, kind string, var string, baseline string, df int, lower double, upper double, "
    "levels array<string>, knots array<double>"
)
PATH_SCHEMA = "alpha_index int, alpha double, n_rows long, n_dropped long, intercept double, coefficients array<double>"
ENCODING_SCHEMA = "place int, name string, source string, kind string, levels array<string>"
MANIFEST_SCHEMA = "number long, version string, kind string, input_cols array<string>"
SUMMARY_SCHEMA = "n_trees int, best_iteration int, history array<double>"


def _write(spark: SparkSession, rows: list, schema: str, path: str) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def save_glm(spark: SparkSession, model: GLMPath, path: str) -> None:
    """Write terms with their levels and knots, and the coefficients of every penalty."""
    terms = []
    for t, term in enumerate(model.design.terms):
        for p, c in enumerate(term):
            spline = isinstance(c, Spline)
            terms.append(
                (
                    t,
                    p,
                    type(c).__name__,
                    c.var,
                    c.baseline if isinstance(c, Cat) else None,
                    c.df if spline else None,
                    float(c.lower) if spline else None,
                    float(c.upper) if spline else None,
                    model.design.levels.get(c.var) if isinstance(c, Cat) else None,
                    model.design.knots.get(c.label) if spline else None,
                )
            )
    _write(spark, terms, TERMS_SCHEMA, f"{path}/terms")
    fits = zip(model.alphas, model.intercepts, model.coefficients)
    rows = [(i, a, model.n_rows, model.n_dropped, b, list(w)) for i, (a, b, w) in enumerate(fits)]
    _write(spark, rows, PATH_SCHEMA, f"{path}/path")


def load_glm(spark: SparkSession, path: str) -> GLMPath:
    terms: dict[int, list[Component]] = {}
    levels: dict[str, list[str]] = {}
    knots: dict[str, list[float]] = {}
    for r in spark.read.parquet(f"{path}/terms").orderBy("term", "place").collect():
        if r["kind"] == "Cat":
            component: Component = Cat(r["var"], r["baseline"])
            levels[r["var"]] = list(r["levels"])
        elif r["kind"] == "Spline":
            component = Spline(r["var"], r["df"], r["lower"], r["upper"])
            knots[component.label] = list(r["knots"])
        else:
            component = Num(r["var"])
        terms.setdefault(r["term"], []).append(component)
    fits = spark.read.parquet(f"{path}/path").orderBy("alpha_index").collect()
    return GLMPath(
        design=Design([tuple(terms[t]) for t in sorted(terms)], levels, knots),
        alphas=[r["alpha"] for r in fits],
        intercepts=[r["intercept"] for r in fits],
        coefficients=[list(r["coefficients"]) for r in fits],
        n_rows=fits[0]["n_rows"],
        n_dropped=fits[0]["n_dropped"],
    )


def save_boost(spark: SparkSession, model: BoostModel, path: str) -> None:
    """Write the encoding, the nodes of every tree and the validation history."""
    encoding = [(i, e.name, e.source, e.kind, list(e.levels)) for i, e in enumerate(model.encoding)]
    _write(spark, encoding, ENCODING_SCHEMA, f"{path}/encoding")
    _write(spark, tree_rows(model.trees), f"tree int, {NODE_SCHEMA}", f"{path}/nodes")
    summary = [(len(model.trees), model.best_iteration, [float(v) for v in model.history])]
    _write(spark, summary, SUMMARY_SCHEMA, f"{path}/summary")


def load_boost(spark: SparkSession, path: str) -> BoostModel:
    encoding = [
        EncodedColumn(r["name"], r["source"], r["kind"], tuple(r["levels"]))
        for r in spark.read.parquet(f"{path}/encoding").orderBy("place").collect()
    ]
    summary = spark.read.parquet(f"{path}/summary").first()
    return BoostModel(encoding, trees_from(spark.read.parquet(f"{path}/nodes")), summary["best_iteration"], list(summary["history"]))


def tree_rows(trees: list[Tree]) -> list[tuple]:
    return [
        (i, n.nodeid, n.depth, n.feature, n.threshold, n.yes, n.no, n.missing, n.gain, n.cover, n.leaf, n.source, n.is_level, n.level)
        for i, tree in enumerate(trees)
        for n in tree.nodes
    ]


def trees_from(nodes: DataFrame) -> list[Tree]:
    trees: dict[int, list[Node]] = {}
    for r in nodes.orderBy("tree", "nodeid").collect():
        fields = r.asDict()
        trees.setdefault(fields.pop("tree"), []).append(Node(**fields))
    return [Tree(trees[i]) for i in sorted(trees)]


def manifest(spark: SparkSession, path: str) -> list:
    """Rows (number, version, kind, input_cols) of the versions committed under ``path``, in order."""
    try:
        return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/manifest").orderBy("number", "version").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def committed_version(spark: SparkSession, path: str) -> str:
    """The folder of the version committed last."""
    rows = manifest(spark, path)
    if not rows:
        raise ValueError(f"no model is committed at {path}")
    return f"{path}/versions/{rows[-1]['version']}"


def save_model(spark: SparkSession, model: GLMPath | BoostModel, path: str, training: DataFrame | None = None) -> str:
    """Write a model as a new version and return its folder; with its ``training`` rows also its schema and a sample.

    The version counts once its row is in the manifest, which is written last. So a save that is cut off
    leaves the version before it in force.
    """
    kind = "glm" if isinstance(model, GLMPath) else "boost"
    version = uuid.uuid4().hex
    folder = f"{path}/versions/{version}"
    (save_glm if kind == "glm" else save_boost)(spark, model, folder)
    if training is not None:
        schemas = scoring_schema(training, model.input_cols)
        _write(spark, sorted(schemas.items()), "role string, schema string", f"{folder}/schema")
        overwrite_parquet(sample_input(training, model.input_cols), f"{folder}/sample")
    known = manifest(spark, path)
    row = (known[-1]["number"] + 1 if known else 1, version, kind, list(model.input_cols))
    append_records(spark.createDataFrame([row], MANIFEST_SCHEMA), f"{path}/manifest")
    return folder


def load_model(spark: SparkSession, path: str) -> GLMPath | BoostModel:
    """The model committed last under ``path``."""
    folder = committed_version(spark, path)
    return load_glm(spark, folder) if manifest(spark, path)[-1]["kind"] == "glm" else load_boost(spark, folder)
