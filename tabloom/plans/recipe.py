"""Replayable recipes (R1-R7): an ordered list of fitted steps.

A recipe is fitted once on training data (one aggregate pass per step that
needs parameters, each on the output of the step before) and then replayed
unchanged on any table, batch or stream: replay is a fold of lazy column
projections that Catalyst fuses into one stage.  Parameters are plain JSON.
Undo is a rebuild from the source table without the removed steps, so no
snapshot of the data is ever kept.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tabloom.operators.clean import null_guard
from tabloom.operators.transform import NULL_GUARDED, OPS


@dataclass
class Step:
    op: str
    cols: list[str]
    options: dict = field(default_factory=dict)
    params: dict | None = None

    @property
    def key(self) -> tuple:
        return (self.op, tuple(self.cols))

    def to_dict(self) -> dict:
        return {"op": self.op, "cols": self.cols, "options": self.options, "params": self.params}


# names a table that lies beside a saved recipe
BESIDE = "beside:"


@dataclass
class Recipe:
    steps: list[Step] = field(default_factory=list)
    features: list[str] | None = None  # selected feature columns, kept with the recipe
    target: str | None = None

    # R1 + R2
    def stage(self, op: str, cols: list[str], **options) -> "Recipe":
        """Append an unfitted step; the same operation on the same columns is refused."""
        if op not in OPS:
            raise ValueError(f"unknown operation {op}")
        step = Step(op, list(cols), options)
        if any(s.key == step.key for s in self.steps):
            raise ValueError(f"operation already staged: {op} on {cols}")
        return Recipe(self.steps + [step], self.features, self.target)

    def preview(self, df: DataFrame, op: str, cols: list[str], n: int = 20, order_by: list[str] | None = None,
                **options) -> DataFrame:
        """The result of one candidate step beside its source columns, on ``n`` rows (fitted on all rows)."""
        fit, apply, suffix, _ = OPS[op]
        params = fit(df, cols, **options)
        out = apply(df, cols, params, suffix)
        return (out.orderBy(*order_by) if order_by else out).limit(n)

    # R3
    def fit(self, df: DataFrame) -> "Recipe":
        """Fit every step in order, each on the previous step's output."""
        fitted, cur = [], df
        for s in self.steps:
            fit, apply, _, _ = OPS[s.op]
            if s.op in NULL_GUARDED:
                null_guard(cur, s.cols)
            params = fit(cur, s.cols, **s.options)
            fitted.append(Step(s.op, s.cols, s.options, params))
            cur = apply(cur, s.cols, params, None)
        return Recipe(fitted, self.features, self.target)

    # R4
    def transform(self, df: DataFrame, project: bool = True) -> DataFrame:
        """Replay fitted steps (no refit); missing dropped columns are skipped."""
        cur = df
        for s in self.steps:
            if s.params is None:
                raise ValueError(f"step {s.op} on {s.cols} is not fitted")
            _, apply, _, _ = OPS[s.op]
            cols = s.cols
            if s.op == "drop_columns":
                cols = [c for c in cols if c in cur.columns]
            cur = apply(cur, cols, s.params, None)
        if project and self.features:
            keep = [c for c in self.features + ([self.target] if self.target else []) if c in cur.columns]
            cur = cur.select(*keep)
        return cur

    def fit_transform(self, df: DataFrame) -> tuple["Recipe", DataFrame]:
        fitted = self.fit(df)
        return fitted, fitted.transform(df, project=False)

    # R5
    def list_steps(self, spark: SparkSession) -> DataFrame:
        rows = [(i, s.op, ",".join(s.cols), json.dumps(s.params, sort_keys=True, default=str))
                for i, s in enumerate(self.steps)]
        return spark.createDataFrame(rows, "step int, op string, columns string, params string")

    # R6
    def remove_steps(self, idx: list[int], source: DataFrame | None = None) -> "Recipe":
        """Drop steps; when ``source`` is given the rest is refitted from it (rebuild, not inverse)."""
        kept = Recipe([Step(s.op, s.cols, s.options) for i, s in enumerate(self.steps) if i not in set(idx)],
                      self.features, self.target)
        return kept.fit(source) if source is not None else kept

    def inverse(self, df: DataFrame) -> DataFrame:
        """Undo steps that have an inverse (encoders, log), last step first."""
        cur = df
        for s in reversed(self.steps):
            inv = OPS[s.op][3]
            if inv is None:
                raise ValueError(f"{s.op} has no inverse; rebuild from the source instead")
            cur = inv(cur, s.cols, s.params, None)
        return cur

    # R7
    def touched_columns(self) -> list[str]:
        seen = []
        for s in self.steps:
            for c in s.cols:
                if c not in seen:
                    seen.append(c)
        return seen

    def view_transformed(self, df: DataFrame) -> DataFrame:
        out = self.transform(df, project=False)
        cols = [c for c in out.columns if any(c == t or c.startswith(f"{t}_") for t in self.touched_columns())]
        return out.select(*cols)

    # persistence (pure parameters)
    def to_json(self) -> str:
        return json.dumps({"steps": [s.to_dict() for s in self.steps], "features": self.features,
                           "target": self.target}, default=str)

    @staticmethod
    def from_json(text: str) -> "Recipe":
        d = json.loads(text)
        return Recipe([Step(s["op"], s["cols"], s.get("options") or {}, s.get("params")) for s in d["steps"]],
                      d.get("features"), d.get("target"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the recipe as a one-row JSON text file (any Hadoop file system).

        Fitted tables (long label lists) are copied to ``<path>.tables``, so the saved recipe holds nothing
        of the scratch folder and can be moved together with that folder.
        """
        d = json.loads(self.to_json())
        for i, step in enumerate(d["steps"]):
            tables = (step.get("params") or {}).get("tables") or {}
            for k, (c, source) in enumerate(sorted(tables.items())):
                name = f"{i}-{k}"
                spark.read.parquet(source).write.mode("overwrite").parquet(f"{path.rstrip('/')}.tables/{name}")
                tables[c] = f"{BESIDE}{name}"
        spark.createDataFrame([(json.dumps(d, default=str),)], "recipe string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Recipe":
        recipe = Recipe.from_json(spark.read.text(path).collect()[0][0])
        for step in recipe.steps:
            tables = (step.params or {}).get("tables") or {}
            for c, name in tables.items():
                if name.startswith(BESIDE):
                    tables[c] = f"{path.rstrip('/')}.tables/{name[len(BESIDE):]}"
        return recipe
