"""One evaluation feeding several outputs, with storage that is released when they are done.

A frame that several writes use would be computed once for each. ``SharedFrames`` keeps it for the time of a block: ``stored`` in files under the shared folder, which
survive lost executors and suit work that is dear to repeat, ``persisted`` in executor memory and disk, which is cheaper for what can be recomputed. Leaving the block, also by an error,
removes the files and the cached blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from tidewright.session import scratch_path


class SharedFrames:
    def __init__(self, spark: SparkSession):
        self.spark, self._paths, self._frames, self._open = spark, [], [], False

    def __enter__(self) -> SharedFrames:
        self._open = True
        return self

    def __exit__(self, *_) -> None:
        self._open = False
        for frame in self._frames:
            frame.unpersist(blocking=True)
        for path in self._paths:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self._frames, self._paths = [], []

    def _check(self) -> None:
        if not self._open:
            raise RuntimeError("frames are shared inside the with block only")

    def stored(self, df: DataFrame, label: str = "shared") -> DataFrame:
        """``df`` written once and read by every use inside the block."""
        self._check()
        path = scratch_path(self.spark, label)
        self._paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def persisted(self, df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
        """``df`` cached from its first use on; blocks that an executor takes with it are computed again."""
        self._check()
        cached = df.persist(level)
        self._frames.append(cached)
        return cached


def write_outputs(df: DataFrame, outputs: dict[str, Callable[[DataFrame], DataFrame]], keep: str = "files") -> dict[str, str]:
    """Evaluate ``df`` once and write each output made from it; returns their paths.

    ``keep`` says how ``df`` is held meanwhile: ``files`` or ``memory``. Nothing of it is left afterwards.
    """
    if keep not in ("files", "memory"):
        raise ValueError("keep is files or memory")
    paths = {}
    with SharedFrames(df.sparkSession) as shared:
        frame = shared.stored(df) if keep == "files" else shared.persisted(df)
        for label, make in outputs.items():
            paths[label] = scratch_path(df.sparkSession, label)
            make(frame).write.parquet(paths[label])
    return paths
