"""Duplicate filter for arriving files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.streaming.tables import HashSet, overwrite


def upload_sink(
    root: str,
    read_catalog: Callable[[SparkSession], DataFrame],
    order: str = "upload_id",
    compact_every: int = 20,
    cells: int = 16,
):
    """foreachBatch function that lets each file in once: upload rows with file_hash and `order`.

    A batch's first file of a hash is new if neither an earlier batch has let the hash in
    nor the catalog holds it, which `read_catalog` reads again for each batch. New rows
    go under `new`, all others under `copies`. Hashes that were let in are kept for good,
    so copies are found however far apart and however late they come. A repeated batch
    writes its files anew. Carry keys, not texts.

    Hashes lie in `cells` cells with a Bloom filter each: a batch reads the filters of its
    cells and only those cells that may hold one of its hashes. Choose `cells` so that one holds a few
    million hashes.
    """
    table = HashSet(f"{root}/hashes", "file_hash", compact_every, cells)

    def apply(uploads: DataFrame, batch: int) -> None:
        spark = uploads.sparkSession
        first = uploads.groupBy("file_hash").agg(F.min(order).alias("_first"))
        let_in = table.held(spark, first, batch - 1)
        if let_in is not None:
            first = first.join(let_in, "file_hash", "left_anti")
        first = first.join(read_catalog(spark).select("file_hash"), "file_hash", "left_anti")
        path = f"{root}/decided/batch={batch}"
        # The catalog may grow while the batch runs; one written decision serves all outputs.
        overwrite(first, path)
        first = spark.read.schema(first.schema).parquet(path)
        marked = uploads.join(first, "file_hash", "left")
        new = F.coalesce(F.col("_first") == F.col(order), F.lit(False))
        overwrite(marked.where(new).drop("_first"), f"{root}/new/batch={batch}")
        overwrite(marked.where(~new).drop("_first"), f"{root}/copies/batch={batch}")
        table.write(first.select("file_hash"), batch)

    return apply
