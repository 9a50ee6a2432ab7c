"""Rankings sources as Spark data sources: a class for each, found by its slug."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RECORD = "source string, player_id string, name string, position string, team string, rank int, value double, captured_at string"
KIND = pa.schema([("source", pa.string()), ("player_id", pa.string()), ("name", pa.string()), ("position", pa.string()), ("team", pa.string()), ("rank", pa.int32()), ("value", pa.float64()), ("captured_at", pa.string())])
BATCH = 8192
REGISTRY: dict[str, type[DataSource]] = {}


def source(slug: str):
    def add(cls: type[DataSource]) -> type[DataSource]:
        cls.name = classmethod(lambda c: slug)
        REGISTRY[slug] = cls
        return cls

    return add


class _Lines(DataSourceReader):
    """One partition for each path of the option `paths`."""

    def __init__(self, options: dict, fields: dict[str, str]) -> None:
        self.paths, self.fields = options["paths"].split(","), fields

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        """Arrow batches; a file is read as it comes, never whole."""
        path = partition.value
        store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        with store.open_input_stream(name) as f, io.TextIOWrapper(f, encoding="utf-8") as lines:
            held: list[dict] = []
            for line in lines:
                if line.strip():
                    held.append(self._record(json.loads(line)))
                if len(held) == BATCH:
                    yield pa.RecordBatch.from_pylist(held, KIND)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, KIND)

    def _record(self, r: dict) -> dict:
        got = {k: r.get(v) for k, v in self.fields.items()}
        for k, kind in (("rank", int), ("value", float)):
            try:
                got[k] = None if got[k] in (None, "", "NA") else kind(float(got[k]))
            except (TypeError, ValueError):
                got[k] = None
        return {k: v if k in ("rank", "value") or v is None else str(v) for k, v in got.items()}


@source("ranking_lines")
class RankingLines(DataSource):
    """JSON lines that already have the record's names."""

    FIELDS = {k: k for k in ("source", "player_id", "name", "position", "team", "rank", "value", "captured_at")}

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return _Lines(self.options, self.FIELDS)


@source("draft_lines")
class DraftLines(RankingLines):
    """Draft picks, the pick as the rank."""

    FIELDS = {"source": "source", "player_id": "gsis_id", "name": "player_name", "position": "position", "team": "team", "rank": "pick", "value": "round", "captured_at": "season"}


def register(spark: SparkSession) -> None:
    for cls in REGISTRY.values():
        spark.dataSource.register(cls)
