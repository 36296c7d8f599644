"""Column roles of a cohort table and the feature split by type."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class TableRoles:
    id_cols: tuple[str, ...]
    group_col: str | None
    target_cols: tuple[str, ...]
    categorical_cols: tuple[str, ...] = field(default_factory=tuple)

    def to_json(self) -> str:
        d = asdict(self)
        return json.dumps({k: list(v) if isinstance(v, tuple) else v for k, v in d.items()})

    @staticmethod
    def from_json(text: str) -> "TableRoles":
        d = json.loads(text)
        return TableRoles(
            id_cols=tuple(d["id_cols"]),
            group_col=d.get("group_col"),
            target_cols=tuple(d["target_cols"]),
            categorical_cols=tuple(d.get("categorical_cols", ())),
        )


@dataclass(frozen=True)
class FeatureSpec:
    numeric_cols: tuple[str, ...]
    categorical_cols: tuple[str, ...]

    @property
    def all_cols(self) -> tuple[str, ...]:
        return self.numeric_cols + self.categorical_cols


def infer_feature_spec(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> FeatureSpec:
    """Strings are categorical, numbers and booleans numeric; order kept."""
    skip = set(exclude)
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in skip:
            continue
        if isinstance(f.dataType, T.StringType):
            cat.append(f.name)
        elif isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            num.append(f.name)
    return FeatureSpec(tuple(num), tuple(cat))


def drop_roles(df: DataFrame, roles: TableRoles, *, ids: bool, targets: bool) -> DataFrame:
    """Column exclusion by role (P17): C2ST drops ids and targets, MIA ids,
    utility and importance only the targets."""
    cols = []
    if ids:
        cols += list(roles.id_cols)
    if targets:
        cols += list(roles.target_cols)
    return df.drop(*[c for c in cols if c in df.columns])
