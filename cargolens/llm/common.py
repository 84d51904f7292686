"""Small helpers shared by the operators."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark drops a query's shuffle files as soon as it has ended.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and go on from
    the files: what follows does not run its lineage again, and a lost
    executor costs a re-read. The shuffles that led to it are not needed any more
    and go at once, so that a job of many steps does not keep all of them on disk."""
    spark = df.sparkSession
    checkpoint_dir(spark)  # hands spark.checkpoint.dir to the context
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        # The frame takes over the setting of the session when it is planned; a new one is planned here.
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, everything else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def worker_local(key: Hashable, make: Callable[[], Any]) -> Any:
    """One object per Python worker, which serves many tasks: ``make()`` on first use.

    Functions are pickled by value here, so a module's globals would start
    anew in every task; only caches and read-only tables belong in it.
    """
    home = sys.modules.setdefault("cargolens_worker_local", types.ModuleType("cargolens_worker_local"))
    kept = home.__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_hashes(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of a whole row; together they tell different rows apart."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    return F.xxhash64(*columns), F.xxhash64(F.lit("twin"), *columns)


def one_of_each(marked: DataFrame, row: list[str]) -> DataFrame:
    """(*row, ``kept``): one row, as a struct of the other columns, for each pair of row hashes. Copies are
    left out in the task that reads them, so a row that repeats without end is one row a task."""
    columns = F.struct(*[F.col(f"`{c}`") for c in marked.columns if c not in row])
    return marked.groupBy(*row).agg(F.first(columns).alias("kept"))
