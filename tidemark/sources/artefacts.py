"""Files for readers outside Spark, and results kept by what they were made from.

A class of rows becomes one or more JSON files of bounded size, whose names and bytes follow from the
rows alone: a second run, or a task that is run again, writes the same bytes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import placed
from .refresh import existing

FILE_ROWS = 50_000


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and the path in it, of a local path or a store's URI."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlsplit(path).path)
    if "://" in path:
        return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return fs.LocalFileSystem(), path


def put(path: str, data: bytes) -> None:
    """Writes a file that readers never see half done."""
    store, name = store_of(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    part = f"{name}.{hashlib.sha256(data).hexdigest()[:16]}.part"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, name)


def class_files(rows: DataFrame, by: str, order: Sequence[Column | str], tie: str, path: str, name: str, version: str, file_rows: int = FILE_ROWS) -> dict:
    """Writes {path}/{name}_{class}.json (and {name}_{class}.1.json and so on, for classes of more than `file_rows` rows) and
    {path}/{name}_index.json; returns what the index says.

    A file is {"version", "class", "part", "n", "rows"}, keys sorted, rows in the given order, which `tie`
    makes strict.  Classes are numbered within by ranges, so a large one is in no single task; the driver
    gets a line for each file."""
    columns = sorted(c for c in rows.columns)
    numbered = placed(rows.withColumn("_json", F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns)), {"ignoreNullFields": "false"})), [*order, tie], by=by, out="_n")
    numbered = numbered.select(F.col(by).cast("string").alias("_class"), F.floor((F.col("_n") - 1) / file_rows).cast("long").alias("_part"), "_n", "_json")

    def write(t: pa.Table) -> pa.Table:
        t = t.sort_by("_n")
        kind, part = t.column("_class")[0].as_py(), t.column("_part")[0].as_py()
        held = [json.loads(x) for x in t.column("_json").to_pylist()]
        data = json.dumps({"version": version, "class": kind, "part": part, "n": len(held), "rows": held}, indent=1, sort_keys=True, ensure_ascii=False).encode()
        file = f"{name}_{kind}{f'.{part}' if part else ''}.json"
        put(f"{path.rstrip('/')}/{file}", data)
        return pa.table({"class": pa.array([kind], pa.string()), "part": [part], "file": [file], "n": [len(held)], "sha256": [hashlib.sha256(data).hexdigest()]})

    done = numbered.groupBy("_class", "_part").applyInArrow(write, "class string, part long, file string, n long, sha256 string").collect()
    index = {"version": version, "files": [r.asDict() for r in sorted(done, key=lambda r: (r["class"] or "", r.part))]}
    put(f"{path.rstrip('/')}/{name}_index.json", json.dumps(index, indent=1, sort_keys=True).encode())
    return index


def penalty_files(stacked: DataFrame, path: str, version: str) -> dict:
    """One file for each kind of penalty: every player's figures, and why they are lower than the raw ones."""
    parts = {"survival": ["bust_rate", "short_rate", "top5_busts", "survival"], "confidence": ["career_games", "confidence", "baseline"], "late_breakout": ["breakout_age", "late"], "missed_season": ["last_season", "last_games", "missed"]}
    rows = [stacked.select(F.lit(k).alias("penalty"), F.to_json(F.struct(*(c for c in cs if c in stacked.columns)), {"ignoreNullFields": "false"}).alias("figures"), "player", "position") for k, cs in parts.items()]
    every = rows[0]
    for r in rows[1:]:
        every = every.union(r)
    return class_files(every, "penalty", ["player"], "player", path, "penalties", version)


def fingerprint(rows: DataFrame) -> str:
    """A digest of the schema and of all rows, whatever their order: counts and sums of two hashes of each."""
    packed = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(rows.columns))), {"ignoreNullFields": "false"})
    one, two = F.xxhash64(packed).cast("decimal(38,0)"), F.xxhash64(packed, F.lit(1)).cast("decimal(38,0)")
    got = rows.agg(F.count(F.lit(1)), F.sum(one), F.sum(two)).first()
    return hashlib.sha256(json.dumps([sorted((f.name, f.dataType.simpleString()) for f in rows.schema.fields), *map(str, got)]).encode()).hexdigest()


def cached(spark: SparkSession, path: str, inputs: Mapping[str, DataFrame], build: Callable[[], DataFrame], version: str = "1") -> tuple[DataFrame, bool]:
    """(the result of `build`, whether it was there already).

    Results are kept below `path` by the fingerprints of the inputs and the version of the code, so a changed
    input or version builds anew; what was built before stays for those who still read it."""
    key = hashlib.sha256(json.dumps({"version": version, **{k: fingerprint(df) for k, df in inputs.items()}}, sort_keys=True).encode()).hexdigest()[:32]
    where = f"{path.rstrip('/')}/{key}"
    store, name = store_of(where)
    if store.get_file_info(f"{name}/_SUCCESS").type != fs.FileType.NotFound and (there := existing(spark, where)) is not None:
        return there, True
    rows = build()
    rows.write.mode("overwrite").parquet(where)
    return spark.read.schema(rows.schema).parquet(where), False
