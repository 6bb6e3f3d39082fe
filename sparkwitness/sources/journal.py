"""Append-only journals that several writers share: one record a key, whoever writes it.

A journal is a folder of immutable parts and of numbered versions.  A version
is a small file that names all parts that count.  An append writes its new
records as a part that nobody reads yet and then takes the next version number,
which succeeds for one writer only; the others look again at what is there,
leave out the keys that have come in and try the number after it.  A failed job
or a lost writer leaves a part that no version names.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Journal:
    """Records in ``path`` with the columns of ``schema``; ``keys`` tell records apart (null is a value)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]) -> None:
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *parts: hadoop("/".join((self.path, *parts)))
        self.fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path("versions"))

    def version(self) -> int:
        """The last version, 0 for an empty journal."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path("versions"))]
        return max([int(n) for n in names if n.isdigit()], default=0)

    def parts(self, version: int) -> list[str]:
        """The parts that a version names."""
        if not version:
            return []
        stream = self.fs.open(self._path("versions", f"{version:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The records of a version, the last one unless another is named."""
        parts = self.parts(self.version() if version is None else version)
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*[f"{self.path}/parts/{p}" for p in parts]) if parts else self.spark.createDataFrame([], self.schema)

    def _take(self, version: int, parts: list[str]) -> bool:
        """Name the parts by a version; false where another writer has taken the number."""
        draft, target = self._path("versions", f"draft-{uuid.uuid4().hex}"), self._path("versions", f"{version:012d}")
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        try:
            if self.fs.getScheme() != "file":
                return bool(self.fs.rename(draft, target))  # fails where the target exists
            # A local rename would replace the target; a link never does.
            os.link(draft.toUri().getPath(), target.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            self.fs.delete(draft, False)

    def append(self, records: DataFrame) -> int:
        """Add the records whose key is not there yet and return the version that has them.

        Of records with equal keys the smallest one is taken.  The records are
        read again for each try.
        """
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        rest = [c for c in columns if c not in self.keys]
        one = records.groupBy(*self.keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*self.keys, *[F.col(f"_r.{c}").alias(c) for c in rest]) if rest else records.select(*columns).distinct()
        while True:
            at = self.version()
            there = self.read(at).select(*[F.col(k).alias(f"_{k}") for k in self.keys])
            same = F.lit(True)
            for k in self.keys:
                same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
            part = uuid.uuid4().hex
            one.join(there, same, "left_anti").select(*columns).write.parquet(f"{self.path}/parts/{part}")
            if self._take(at + 1, [*self.parts(at), part]):
                return at + 1

    def conflicts(self, records: DataFrame) -> DataFrame:
        """Records whose key the journal has with other content."""
        there = self.read()
        names = {c: f"_{c}" for c in there.columns}
        same, other = F.lit(True), F.lit(False)
        for c in there.columns:
            equal = F.col(c).eqNullSafe(F.col(f"_{c}"))
            same, other = (same & equal, other) if c in self.keys else (same, other | ~equal)
        return records.join(there.withColumnsRenamed(names), same & other, "left_semi")
