"""A table in named slices and one default slice for all else, and rows moved from the default into slices of their own.

The slices are partitions of a Parquet folder. Every change is first staged beside the table and then replaces whole partitions (dynamic overwrite). A move writes the named
slice before it takes its rows from the default one, so a move that breaks off loses no row; repeated, it adds nothing twice, as rows whose key the
slice has already are left out. Until it is repeated ``rows`` shows each key once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.network import checkpointed

DEFAULT = "__default__"
_SLICE = "slice"


class SlicedTable:
    """Rows of ``schema`` at ``folder``, sliced by the upper case of column ``by``; ``keys`` tell rows apart and include ``by``."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, by: str, keys: list[str]) -> None:
        self.spark, self.folder, self.schema, self.by, self.keys = spark, folder, schema, by, list(keys)
        if by not in keys:
            raise ValueError("keys must include the column that slices go by")

    def _system(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def slices(self) -> set[str]:
        """Names of the slices that exist, the default one left out."""
        system, at = self._system()
        if not system.exists(at):
            return set()
        names = [s.getPath().getName() for s in system.listStatus(at)]
        return {n.removeprefix(f"{_SLICE}=") for n in names if n.startswith(f"{_SLICE}=")} - {DEFAULT}

    def ensure_slice(self, name: str) -> None:
        """Makes a slice, empty at first; rows inserted from then on go there. Rows of the name that lie in the default slice stay until ``rebalance``."""
        if not name or "/" in name:
            raise ValueError(f"not a name of a slice: {name!r}")
        system, at = self._system()
        system.mkdirs(self.spark._jvm.org.apache.hadoop.fs.Path(at, f"{_SLICE}={name.upper()}"))

    def stored(self) -> DataFrame:
        """All rows with the slice that they lie in."""
        system, at = self._system()
        whole = StructType([*self.schema, StructField(_SLICE, StringType())])
        if not system.exists(at):
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(self.folder)

    def rows(self) -> DataFrame:
        """The table's rows; of a key that lies both in its slice and in the default one, as after a move that broke off, the one in its slice."""
        own = self.stored()
        moved = own.where(F.col(_SLICE) != DEFAULT).select(*self.keys)
        left = own.where(F.col(_SLICE) == DEFAULT).join(moved, self.keys, "left_anti")
        return own.where(F.col(_SLICE) != DEFAULT).unionByName(left).select(*self.schema.names)

    def _replace(self, staged: DataFrame) -> None:
        staged.repartition(_SLICE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_SLICE).parquet(self.folder)

    def insert(self, rows: DataFrame) -> None:
        """Adds the rows whose key the table lacks, into the slice of their name if it exists, else into the default one; of equal keys in ``rows`` one is taken.

        Rows with a null in a key, which no key equals, are an error.
        """
        rows = checkpointed(rows.select(*self.schema.names))
        if not rows.where(" or ".join(f"`{k}` is null" for k in self.keys)).isEmpty():
            raise ValueError("rows with a null key")
        named = F.upper(F.col(self.by).cast("string"))
        known = self.slices()
        slice_ = F.when(named.isin(sorted(known)), named).otherwise(DEFAULT) if known else F.lit(DEFAULT)
        fresh = rows.dropDuplicates(self.keys).join(self.stored().select(*self.keys), self.keys, "left_anti").withColumn(_SLICE, slice_)
        # what is added lies beside what the slices hold: nothing there is written again
        checkpointed(fresh).repartition(_SLICE).write.mode("append").partitionBy(_SLICE).parquet(self.folder)

    def rebalance(self, name: str, between: Callable[[], None] | None = None) -> int:
        """Moves the rows of a name from the default slice into its own, made if need be, and returns how many lay there. ``between`` is called between the two steps."""
        name = name.upper()
        self.ensure_slice(name)
        own = self.stored()
        default = own.where(F.col(_SLICE) == DEFAULT)
        mine = F.upper(F.col(self.by).cast("string")).eqNullSafe(F.lit(name))
        moving = checkpointed(default.where(mine).dropDuplicates(self.keys))
        count = moving.count()
        if count:
            held = own.where(F.col(_SLICE) == name)
            added = moving.join(held.select(*self.keys), self.keys, "left_anti").withColumn(_SLICE, F.lit(name))
            self._replace(checkpointed(held.unionByName(added)))
            if between is not None:
                between()
            rest = checkpointed(self.stored().where((F.col(_SLICE) == DEFAULT) & ~mine))
            if rest.isEmpty():
                # a partition without rows is not replaced by an overwrite
                system, at = self._system()
                system.delete(self.spark._jvm.org.apache.hadoop.fs.Path(at, f"{_SLICE}={DEFAULT}"), True)
            else:
                self._replace(rest)
        return count
