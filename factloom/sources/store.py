"""Stores for workflow logs: facts, run events, inputs and states in parts that are written whole, specs, and lists of workflows."""

from __future__ import annotations

import abc
import json
from typing import Any
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession


class Store(abc.ABC):
    """What a runner needs of a store. A log is a DataFrame in parts; specs are plain data."""

    @abc.abstractmethod
    def append(self, workflow_id: str, kind: str, rows: DataFrame, part: str) -> None:
        """Add rows to a workflow's log of a kind as a part; a part that is there already is replaced, so that doing it
        twice is doing it once."""

    @abc.abstractmethod
    def stream(self, workflow_id: str, kind: str, part: str | None = None) -> DataFrame | None:
        """All rows of a log so far, or those of one part; None if there are none."""

    @abc.abstractmethod
    def purge(self, workflow_id: str, kind: str) -> None:
        """Drop a log; the workflow and its other logs stay."""

    @abc.abstractmethod
    def save(self, workflow_id: str, spec: Any) -> None:
        """Keep a workflow's spec."""

    @abc.abstractmethod
    def load(self, workflow_id: str) -> Any:
        """The spec that was kept last; KeyError if none was."""

    @abc.abstractmethod
    def delete(self, workflow_id: str) -> None:
        """Forget a workflow and its logs."""

    @abc.abstractmethod
    def list(self) -> list[str]:
        """Ids of all workflows that were saved and not deleted."""

    def exists(self, workflow_id: str) -> bool:
        return workflow_id in self.list()


class MemoryStore(Store):
    """Logs as DataFrames in this session: nothing is written here. The runner's tables are written by itself."""

    def __init__(self) -> None:
        self.logs: dict[tuple[str, str], dict[str, DataFrame]] = {}
        self.specs: dict[str, Any] = {}

    def append(self, workflow_id: str, kind: str, rows: DataFrame, part: str) -> None:
        self.logs.setdefault((workflow_id, kind), {})[part] = rows

    def stream(self, workflow_id: str, kind: str, part: str | None = None) -> DataFrame | None:
        found = self.logs.get((workflow_id, kind), {})
        if part is not None:
            return found.get(part)
        out = None
        for rows in found.values():
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def purge(self, workflow_id: str, kind: str) -> None:
        self.logs.pop((workflow_id, kind), None)

    def save(self, workflow_id: str, spec: Any) -> None:
        self.specs[workflow_id] = spec

    def load(self, workflow_id: str) -> Any:
        return self.specs[workflow_id]

    def delete(self, workflow_id: str) -> None:
        self.specs.pop(workflow_id, None)
        for key in [k for k in self.logs if k[0] == workflow_id]:
            del self.logs[key]

    def list(self) -> list[str]:
        return sorted(self.specs)


class ParquetStore(Store):
    """Logs as Parquet below a folder that Spark reads and writes: <path>/<id>/logs/<kind>/part=<part>. Spark's
    committer makes each part whole or nothing. A spec is one row of JSON in <path>/<id>/spec."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, workflow_id: str, *below: str) -> str:
        return "/".join([self.path, quote(workflow_id, safe=""), *below])

    def _files(self, path: str) -> tuple[Any, Any]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _is_there(self, path: str) -> bool:
        files, at = self._files(path)
        return files.exists(at)

    def append(self, workflow_id: str, kind: str, rows: DataFrame, part: str) -> None:
        rows.write.mode("overwrite").parquet(self._at(workflow_id, "logs", quote(kind, safe=""), f"part={quote(part, safe='')}"))

    def stream(self, workflow_id: str, kind: str, part: str | None = None) -> DataFrame | None:
        at = self._at(workflow_id, "logs", quote(kind, safe=""), *([f"part={quote(part, safe='')}"] if part is not None else []))
        if not self._is_there(at):
            return None
        found = self.spark.read.option("mergeSchema", "true").parquet(at)
        return found if part is not None else found.drop("part")

    def purge(self, workflow_id: str, kind: str) -> None:
        files, at = self._files(self._at(workflow_id, "logs", quote(kind, safe="")))
        files.delete(at, True)

    def save(self, workflow_id: str, spec: Any) -> None:
        row = self.spark.createDataFrame([(json.dumps(spec, default=str),)], "spec string")
        row.coalesce(1).write.mode("overwrite").parquet(self._at(workflow_id, "spec"))

    def load(self, workflow_id: str) -> Any:
        if not self._is_there(at := self._at(workflow_id, "spec")):
            raise KeyError(workflow_id)
        return json.loads(self.spark.read.parquet(at).first()["spec"])

    def delete(self, workflow_id: str) -> None:
        files, at = self._files(self._at(workflow_id))
        files.delete(at, True)

    def list(self) -> list[str]:
        files, at = self._files(self.path)
        if not files.exists(at):
            return []
        return sorted(unquote(f.getPath().getName()) for f in files.listStatus(at) if f.isDirectory())
