"""Work by pandas chunks in which one bad row does not stop the rest."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def process_chunks(df: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "gmail_id", rows: int = 100) -> DataFrame:
    """``work`` on chunks of at most ``rows`` rows; its result has the columns of ``schema``, and ``key`` is one of them.

    If a chunk fails, its rows are tried one by one; a row that fails comes out with its key, nulls, and ``error``.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), rows):
                chunk = frame.iloc[a : a + rows]
                try:
                    yield work(chunk)[names].assign(error=None)
                except Exception:  # tried again row by row, where each failure is kept as a row
                    yield pd.concat([_one(work, chunk.iloc[i : i + 1], names, key) for i in range(len(chunk))], ignore_index=True)

    return df.mapInPandas(run, f"{schema}, error string")


def _one(work, row: pd.DataFrame, names: list[str], key: str) -> pd.DataFrame:
    try:
        return work(row)[names].assign(error=None)
    except Exception as e:  # becomes a row
        return pd.DataFrame([{key: row[key].iloc[0], "error": f"{type(e).__name__}: {e}"[:500]}], columns=[*names, "error"])
