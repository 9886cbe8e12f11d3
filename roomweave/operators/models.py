"""Hooks for models of one's own: detectors, fillers of masks, answerers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

_loaded: dict[str, object] = {}


def apply_model(rows: DataFrame, name: str, load: Callable[[], object], predict: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """predict(model, batch) for batches of rows, as a table of the declared schema.

    load() runs once a worker process and name, when its first batch comes; later tasks of the process find the model loaded.
    What predict returns is checked: another set of columns is an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from roomweave.operators import models

        for batch in batches:
            if name not in models._loaded:
                models._loaded[name] = load()
            made = predict(models._loaded[name], batch)
            if list(made.columns) != names:
                raise ValueError(f"{name} returned {list(made.columns)}, not {names}")
            yield made

    names = rows.sparkSession.createDataFrame([], schema).columns
    return rows.mapInPandas(run, schema)
