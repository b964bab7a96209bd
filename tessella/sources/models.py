"""Model calls as columns: recorded replies, or an injected callable in Arrow batches, created once a worker task."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType, StructField, StructType

from tessella.session import ship


def recorded(requests: DataFrame, replies: DataFrame, key: str) -> DataFrame:
    """Requests with their recorded replies; the reply columns are null where none was recorded."""
    return requests.join(replies, key, "left")


def embedder(make: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32) -> Callable[[Column], Column]:
    """An embedding function: ``make`` loads the model once a task, which then sees ``batch`` texts at a time."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in parts:
            rows = []
            for i in range(0, len(texts), batch):
                rows += model(texts.iloc[i : i + batch].fillna("").tolist())
            yield pd.Series(rows)

    return embed


def chat(requests: DataFrame, make: Callable[[], Callable[[str], str]], prompt: str = "prompt", attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """Requests with reply, error and tries. Filter first: the call is opaque to the optimizer.

    A call that fails is made again after a growing wait; one that keeps failing is a row with its error.
    """
    ship(requests.sparkSession)
    schema = StructType([*requests.schema.fields, StructField("reply", StringType()), StructField("error", StringType()), StructField("tries", IntegerType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for frame in frames:
            done = []
            for text in frame[prompt]:
                reply = error = None
                for n in range(1, attempts + 1):
                    try:
                        reply, error = call(text), None
                        break
                    except Exception as failure:  # noqa: BLE001  a failed call is data
                        error = f"{type(failure).__name__}: {failure}"
                        if n < attempts:
                            time.sleep(wait * 2 ** (n - 1))
                done.append((reply, error, n))
            yield frame.assign(reply=[d[0] for d in done], error=[d[1] for d in done], tries=pd.Series([d[2] for d in done], dtype="int32", index=frame.index))

    return requests.mapInPandas(run, schema)
