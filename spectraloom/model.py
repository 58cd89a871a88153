"""The data model: a study of assays in long form.

Missing measurements are absent rows (or NULL), never NaN: Spark orders and sums NaN as a value.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Assay:
    """One level of quantification.

    ``x`` has obs_id, var_id, value and any further layers as columns; ``var`` describes features by var_id, in the
    order of var_ord; ``decoy`` has the decoys' rows in var's columns. ``filters`` are named
    predicates that ``apply_filter`` will use. ``extra`` holds result tables, such as embeddings.
    """

    x: DataFrame
    var: DataFrame
    decoy: DataFrame | None = None
    level: str = "psm"
    label: str | None = None
    engine: str | None = None
    filters: tuple = ()
    extra: dict[str, DataFrame] = field(default_factory=dict)

    def with_(self, **changes) -> Assay:
        return replace(self, **changes)

    @property
    def has_decoy(self) -> bool:
        return self.decoy is not None

    @property
    def has_purity(self) -> bool:
        return "purity" in self.var.columns

    @property
    def has_pep(self) -> bool:
        return "PEP" in self.var.columns

    def has_quant(self) -> bool:
        return bool(self.x.where(F.col("value").isNotNull()).limit(1).count())


@dataclass(frozen=True)
class Study:
    """Assays that share samples. ``obs`` has obs_id, obs_ord and sample columns; ``tables`` hold maps (peptide_map,
    protein_map, protein_info); ``log`` lists the calls that made the study."""

    assays: dict[str, Assay]
    obs: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    log: tuple[dict, ...] = ()

    def __getitem__(self, name: str) -> Assay:
        return self.assays[name]

    def with_assay(self, name: str, assay: Assay) -> Study:
        return replace(self, assays={**self.assays, name: assay})

    def with_(self, **changes) -> Study:
        return replace(self, **changes)

    def levels(self, level: str) -> dict[str, Assay]:
        found = {k: a for k, a in self.assays.items() if a.level == level}
        if not found:
            raise ValueError(f"no assay of level {level}; there are {sorted(self.assays)}")
        return found

    def label(self) -> str | None:
        """The label of all assays that have one; they must agree."""
        labels = {a.label for a in self.assays.values() if a.label}
        if len(labels) > 1:
            raise ValueError(f"assays have different labels: {sorted(labels)}")
        return next(iter(labels), None)


def logged(f: Callable[..., Study]) -> Callable[..., Study]:
    """Note the call in the study that it returns."""

    @wraps(f)
    def run(study: Study, *args, **kwargs) -> Study:
        out = f(study, *args, **kwargs)
        entry = {"function": f.__name__, "timestamp": datetime.now(timezone.utc).isoformat(), "args": [_plain(a) for a in args], "kwargs": {k: _plain(v) for k, v in kwargs.items()}}
        return out.with_(log=(*out.log, entry))

    return run


def _plain(x):
    if isinstance(x, (str, int, float, bool)) or x is None:
        return x
    if isinstance(x, (list, tuple)):
        return [_plain(i) for i in x]
    return {str(k): _plain(v) for k, v in x.items()} if isinstance(x, dict) else type(x).__name__


def save(study: Study, path: str) -> None:
    """Write every table as Parquet under ``path`` and the rest as one JSON line."""
    spark = study.obs.sparkSession
    study.obs.write.mode("overwrite").parquet(f"{path}/obs")
    meta = {"assays": {}, "tables": sorted(study.tables), "log": list(study.log)}
    for name, a in study.assays.items():
        a.x.write.mode("overwrite").parquet(f"{path}/assays/{name}/x")
        a.var.write.mode("overwrite").parquet(f"{path}/assays/{name}/var")
        if a.decoy is not None:
            a.decoy.write.mode("overwrite").parquet(f"{path}/assays/{name}/decoy")
        for k, df in a.extra.items():
            df.write.mode("overwrite").parquet(f"{path}/assays/{name}/extra/{k}")
        meta["assays"][name] = {"level": a.level, "label": a.label, "engine": a.engine, "decoy": a.has_decoy, "extra": sorted(a.extra)}
    for name, df in study.tables.items():
        df.write.mode("overwrite").parquet(f"{path}/tables/{name}")
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/study")


def load(spark: SparkSession, path: str) -> Study:
    meta = json.loads(spark.read.text(f"{path}/study").first().value)
    assays = {}
    for name, m in meta["assays"].items():
        at = f"{path}/assays/{name}"
        assays[name] = Assay(spark.read.parquet(f"{at}/x"), spark.read.parquet(f"{at}/var"), spark.read.parquet(f"{at}/decoy") if m["decoy"] else None, m["level"], m["label"], m["engine"], extra={k: spark.read.parquet(f"{at}/extra/{k}") for k in m["extra"]})
    return Study(assays, spark.read.parquet(f"{path}/obs"), {k: spark.read.parquet(f"{path}/tables/{k}") for k in meta["tables"]}, tuple(meta["log"]))
