"""State of foreachBatch sinks: small change tables and bases that are made anew now and then.

Rows lie in cells, by a hash of their key and, if a table says so, a span of time. Batch n writes only
the rows it changes, under `changes/batch=n/cell=c`, and a batch that says which keys it needs reads the
cells of those keys only. Every `compact_every` batches the cells that changed are written whole
under `base/batch=n/cell=c`, and what a cell's older base stood on is removed; the base before it is kept, so
a batch that is repeated after a failure finds what it read the first time. A batch that comes
again writes the same files again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batch folders under a path."""
    system, where = _files(spark, path)
    if not system.exists(where):
        return []
    names = [status.getPath().getName() for status in system.listStatus(where)]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    system, where = _files(spark, path)
    if not system.exists(where):
        return []
    names = [status.getPath().getName() for status in system.listStatus(where)]
    return [n.removeprefix(prefix) for n in names if n.startswith(prefix)]


class StateTable:
    """Rows by key; of the rows of a key the newest batch's counts.

    cells: how many cells keys are dealt into; by: the part of the key that decides; span: a column whose
    values have cells of their own.
    """

    def __init__(
        self,
        root: str,
        keys: list[str],
        compact_every: int = 20,
        cells: int = 16,
        by: list[str] | None = None,
        span: str | None = None,
    ):
        self.root, self.keys, self.compact_every = root, keys, compact_every
        self.cells, self.by, self.span = cells, by or keys, span

    def _path(self, kind: str, batch: int) -> str:
        return f"{self.root}/{kind}/batch={batch}"

    def cell(self) -> Column:
        part = F.pmod(F.xxhash64(*self.by), F.lit(self.cells)).cast("string")
        return part if self.span is None else F.concat_ws("_", part, F.col(self.span).cast("string"))

    def cells_of(self, rows: DataFrame) -> set[str]:
        """The cells of rows; at most `cells` names per span."""
        return {r[0] for r in rows.select(self.cell()).distinct().collect()}

    def _layout(self, spark: SparkSession, kind: str, upto: int) -> dict[int, set[str]]:
        found = (b for b in batches(spark, f"{self.root}/{kind}") if b <= upto)
        return {b: set(_folders(spark, self._path(kind, b), "cell=")) for b in found}

    def _parts(self, spark: SparkSession, batch: int, last_base: int, cells: set[str] | None):
        """Batch and paths of what makes up the state of the cells, bases first."""
        bases, changes = self._layout(spark, "base", last_base), self._layout(spark, "changes", batch)
        newest: dict[str, int] = {}
        for b, held in sorted(bases.items()):
            newest |= dict.fromkeys(held, b)
        wanted = lambda c: cells is None or c in cells
        for kind, layout in (("base", bases), ("changes", changes)):
            for b, held in sorted(layout.items()):
                own = [c for c in held if wanted(c) and (newest[c] == b if kind == "base" else newest.get(c, -1) < b)]
                if own:
                    yield b, [f"{self._path(kind, b)}/cell={c}" for c in sorted(own)]

    def read(
        self, spark: SparkSession, batch: int, of: DataFrame | None = None, cells: set[str] | None = None
    ) -> DataFrame | None:
        """The state after a batch; none if no batch up to it has written there.

        of: rows that hold the table's keys; only their cells are read, which may hold other keys too.
        """
        if of is not None:
            cells = self.cells_of(of)
        return self._newest(spark, list(self._parts(spark, batch, batch, cells)))

    def _newest(self, spark: SparkSession, parts: list[tuple[int, list[str]]]) -> DataFrame | None:
        rows = None
        for b, paths in parts:
            part = spark.read.parquet(*paths).withColumn("_batch", F.lit(b))
            rows = part if rows is None else rows.unionByName(part)
        if rows is None or len(parts) == 1:
            return rows and rows.drop("_batch")
        others = [c for c in rows.columns if c not in (*self.keys, "_batch")]
        if not others:
            return rows.select(*self.keys).distinct()
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), "_batch").alias("_row"))
        return newest.select(*self.keys, "_row.*")

    def write(self, changed: DataFrame, batch: int) -> None:
        """Write a batch's changed rows, and new bases of changed cells if they are due."""
        spark = changed.sparkSession
        self._save(changed, self._path("changes", batch))
        if (batch + 1) % self.compact_every == 0:
            self._compact(spark, batch)

    def _save(self, rows: DataFrame, path: str) -> None:
        rows = rows.withColumn("cell", self.cell())
        rows.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(path)

    def _compact(self, spark: SparkSession, batch: int) -> None:
        bases = self._layout(spark, "base", batch - 1)
        based = {c: b for b, held in sorted(bases.items()) for c in held}
        changes = self._layout(spark, "changes", batch)
        due = {c for b, held in changes.items() for c in held if b > based.get(c, -1)}
        if due:
            whole = self._newest(spark, list(self._parts(spark, batch, batch - 1, due)))
            self._save(whole, self._path("base", batch))
        for cell in due & set(based):
            self._clear(spark, cell, based[cell], bases, changes)

    def _clear(self, spark: SparkSession, cell: str, kept: int, bases: dict, changes: dict) -> None:
        """Remove what a cell's last base but one stood on."""
        for kind, layout, limit in (("base", bases, kept), ("changes", changes, kept + 1)):
            for b in [b for b, held in layout.items() if b < limit and cell in held]:
                layout[b].discard(cell)
                folder = f"{self._path(kind, b)}/cell={cell}" if layout[b] else self._path(kind, b)
                system, where = _files(spark, folder)
                system.delete(where, True)


#: Bits a hash has in a Bloom filter, and how many of them it sets: 1 % of absent hashes seem present.
BITS, SET = 10, 7


def _places(first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """Bits of each pair of hashes, in rows."""
    steps = np.arange(SET, dtype=np.uint64)
    with np.errstate(over="ignore"):
        found = first.astype(np.uint64)[:, None] + steps * (second.astype(np.uint64)[:, None] | np.uint64(1))
    return (found % np.uint64(size)).astype(np.int64)


class HashSet(StateTable):
    """A growing set of hashes with a Bloom filter for the base of every cell.

    Asked for some hashes, it reads the filters of their cells, and a cell's base only if a filter says that one
    of the hashes may be there. What came since the base is small and read as it is.
    """

    def __init__(self, root: str, key: str, compact_every: int = 20, cells: int = 16):
        super().__init__(root, [key], compact_every, cells)

    def _hashed(self, rows: DataFrame) -> DataFrame:
        key = self.keys[0]
        return rows.select(key, self.cell().alias("cell"), F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit(1)).alias("b"))

    def _save(self, rows: DataFrame, path: str) -> None:
        super()._save(rows, path)
        if "/base/" not in path:
            return

        def bits(cell: pa.Table) -> pa.Table:
            size = max(64, BITS * cell.num_rows)
            held = np.zeros(size, bool)
            held[_places(*(cell.column(c).to_numpy() for c in "ab"), size)] = True
            packed = pa.array([np.packbits(held).tobytes()], pa.binary())
            return pa.table({"cell": cell.column("cell").slice(0, 1), "size": [size], "bits": packed})

        written = rows.sparkSession.read.parquet(path).select(self.keys[0])
        hashed = self._hashed(written).select("cell", "a", "b").groupBy("cell")
        filters = hashed.applyInArrow(bits, "cell string, size long, bits binary")
        overwrite(filters, path.replace("/base/", "/filters/"))

    def may_hold(self, spark: SparkSession, rows: DataFrame, batch: int) -> set[str]:
        """Cells whose base may hold one of the rows' hashes."""
        newest: dict[str, int] = {}
        for b, held in sorted(self._layout(spark, "base", batch).items()):
            newest |= dict.fromkeys(held, b)
        cells = self.cells_of(rows) & set(newest)
        if not cells:
            return set()
        named = [(b, [c for c in cells if newest[c] == b]) for b in sorted({newest[c] for c in cells})]
        parts = [spark.read.parquet(self._path("filters", b)).where(F.col("cell").isin(own)) for b, own in named]
        filters = parts[0]
        for part in parts[1:]:
            filters = filters.unionByName(part)

        def check(asked: pa.Table, own: pa.Table) -> pa.Table:
            if not own.num_rows or not asked.num_rows:
                return pa.table({"cell": pa.array([], pa.string())})
            size = own.column("size")[0].as_py()
            held = np.unpackbits(np.frombuffer(own.column("bits")[0].as_py(), np.uint8)).astype(bool)
            found = held[_places(*(asked.column(c).to_numpy() for c in "ab"), size)].all(1).any()
            return pa.table({"cell": own.column("cell").slice(0, int(found))})

        asked = self._hashed(rows).select("cell", "a", "b").groupBy("cell")
        return {r[0] for r in asked.cogroup(filters.groupBy("cell")).applyInArrow(check, "cell string").collect()}

    def held(self, spark: SparkSession, rows: DataFrame, batch: int) -> DataFrame | None:
        """The set's hashes after a batch, from every place where one of the rows' hashes may be."""
        cells, likely = self.cells_of(rows), self.may_hold(spark, rows, batch)
        parts = []
        for b, paths in self._parts(spark, batch, batch, cells):
            if "/base/" in paths[0]:
                paths = [p for p in paths if p.rpartition("cell=")[2] in likely]
            if paths:
                parts.append((b, paths))
        return self._newest(spark, parts)
