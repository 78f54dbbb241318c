"""Scans that may fail or must stop early: one request per key, and the best few source files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import question_tokens, tokens


class Transient(Exception):
    """A failure that another attempt may not meet."""


class Spent(Exception):
    """A quota is used up: no key can be read now, so the whole scan ends."""


def fetch_each(keys: DataFrame, fetch: Callable[[object], list[str]], attempts: int = 3, wait: float = 0.5) -> DataFrame:
    """key, payload (a JSON text) and error of every key: transient failures are tried again, others drop the key alone."""
    kind = dict(keys.dtypes)["key"]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for frame in frames:
            rows = []
            for key in frame["key"]:
                for attempt in range(1, attempts + 1):
                    try:
                        rows += [(key, payload, None) for payload in fetch(key)]
                        break
                    except Spent:
                        raise
                    except Transient as e:
                        if attempt == attempts:
                            rows.append((key, None, str(e)))
                        else:
                            time.sleep(wait * 2 ** (attempt - 1))
                    except Exception as e:  # noqa: BLE001  one key's failure is data of this scan
                        rows.append((key, None, str(e)))
                        break
            yield pd.DataFrame(rows, columns=["key", "payload", "error"])

    return keys.select("key").mapInPandas(read, f"key {kind}, payload string, error string")


def best_files(files: DataFrame, question: Column, max_files: int, max_bytes: int) -> DataFrame:
    """files: path, size. Those whose path shares most tokens with the question, up to a number and a total size."""
    share = F.size(F.array_intersect(question_tokens(question), tokens(F.regexp_replace("path", r"[/._]", " "))))
    top = files.withColumn("share", share).orderBy(F.desc("share"), "path").limit(max_files)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("share"), "path")  # at most max_files rows
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("upto", upto).where(F.col("upto") <= max_bytes)


def checksum(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows and an order-free digest of a table, to compare copies of a snapshot."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return rows.select(F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("digest"))
