"""Readers of season, schedule, bridge and snapshot files, with schemas given rather than inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import int_or_null
from ..operators.identity import crosswalk_maps, player_dimension
from ..operators.scouting import stitched

# fixed values: what a ranking says of a player in one format, and its name in the pages' own objects
RANKED = {"rank": ("rank", "int"), "positional_rank": ("positionalRank", "int"), "value": ("value", "int"), "tier": ("overallTier", "int"), "positional_tier": ("positionalTier", "int"), "adp": ("adp", "double"), "startup_adp": ("startupAdp", "double"), "trade_count": ("tradeCount", "int"), "overall_trend": ("overallTrend", "int")}
FORMAT = T.StructType([T.StructField(k, T.DoubleType() if kind == "double" else T.IntegerType()) for k, (_, kind) in RANKED.items()])
SNAPSHOT = T.StructType(
    [
        T.StructField("captured_at", T.StringType()),
        T.StructField("players", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("position", T.StringType()), T.StructField("superflex", FORMAT), T.StructField("one_qb", FORMAT)]))),
    ]
)


def text_columns(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def season_csv(spark: SparkSession, paths: str | list[str], columns: Sequence[str], older: str | None = None) -> DataFrame:
    """All columns as text; an older era's file is appended only if it is given."""
    read = spark.read.option("header", True).schema(text_columns(columns))
    out = read.csv(paths)
    return out.unionByName(read.csv(older)) if older else out


def yearly_csv(spark: SparkSession, pattern: str, columns: Sequence[str], prefix: str) -> DataFrame:
    """One file a year, the year taken from the file's name; rows without a number in `sos` go, and
    of rows with one team the last stays."""
    rows = spark.read.option("header", True).schema(text_columns(columns)).csv(pattern)
    year = F.regexp_extract(F.col("_metadata.file_name"), rf"{prefix}(\d+)", 1).cast("int")
    rows = rows.select("*", year.alias("file_year"), F.monotonically_increasing_id().alias("_at")).withColumn("sos", F.col("sos").try_cast("double")).where("sos is not null")
    return rows.groupBy("file_year", "school").agg(F.max_by("sos", "_at").alias("sos"))


def json_arrays(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """Files that hold one array of objects each; what cannot be parsed is left out."""
    broken = "_corrupt_record"
    rows = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(T.StructType([*schema.fields, T.StructField(broken, T.StringType())])).json(pattern)
    return rows.where(F.col(broken).isNull()).drop(broken)


def keyed_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A file with one object of objects: a row for each key, the value's fields as columns."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string, struct<{value}>>")).alias("key", "v")).select("key", "v.*")


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot's players; an empty frame if the file is missing or broken."""
    try:
        rows = spark.read.option("multiLine", True).schema(SNAPSHOT).json(path)
        return rows.select("captured_at", F.inline("players"))
    except Exception as e:  # Spark names the reason in the error's class
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SNAPSHOT).select("captured_at", F.inline("players"))


def embedded_objects(pages: DataFrame, html: str, variable: str, item: str) -> DataFrame:
    """Objects of an array that a page's script assigns to `variable`.

    The array ends where its JSON does, so brackets and semicolons in its texts do no harm."""
    found = F.regexp_extract(html, rf"(?s)\b{variable}\s*=\s*(\[.*)", 1)
    return pages.select(F.explode(F.from_json(found, f"array<struct<{item}>>")).alias("p")).select("p.*")


def embedded_array(pages: DataFrame, html: str, variable: str, item: str) -> DataFrame:
    """The same; those without id or name go."""
    return embedded_objects(pages, html, variable, item).where("id is not null and name is not null")


def ranked_in(column: str) -> Column:
    """One format's figures from a page's object, whose numbers may be texts; what is no number is null."""
    whole = lambda k, kind: (F.col(f"{column}.{k}").try_cast("double").try_cast(kind))
    return F.struct(*(whole(k, kind).alias(name) for name, (k, kind) in RANKED.items()))


def page_snapshot(pages: DataFrame, html: str, variable: str = "playersArray") -> DataFrame:
    """The players of a rankings page with their figures in both formats."""
    figures = ", ".join(f"{k}: string" for k, _ in RANKED.values())
    rows = embedded_objects(pages, html, variable, f"playerID: long, playerName: string, position: string, team: string, superflexValues: struct<{figures}>, oneQBValues: struct<{figures}>")
    rows = rows.where("playerID is not null and playerName is not null")
    return rows.select(F.col("playerID").alias("id"), F.col("playerName").alias("name"), "position", "team", ranked_in("superflexValues").alias("superflex"), ranked_in("oneQBValues").alias("one_qb"))


STATS = ("games", "completions", "attempts", "passing_yards", "passing_tds", "interceptions", "carries", "rushing_yards", "rushing_tds", "receptions", "targets", "receiving_yards", "receiving_tds")


def player_seasons(spark: SparkSession, paths: str | list[str], older: str | None = None, crossover: DataFrame | None = None, stats: Sequence[str] = STATS) -> DataFrame:
    """Season lines with whole numbers as numbers: player_id, name, position, season, season_type, recent_team and
    `stats`; NA and blanks are null.

    An older era's file is appended if it is given.  Its ids are rewritten by `crossover` (old, new) where the new id has
    seasons of its own in the other files, so that a career that spans both is one."""
    columns = ["season", "season_type", "player_id", "player_name", "position", "recent_team", *stats]

    def read(path: str | list[str]) -> DataFrame:
        rows = spark.read.option("header", True).option("enforceSchema", False).csv(path)
        have = [F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]
        return rows.select(*have).where("player_id is not null and player_id <> ''")

    new = read(paths)
    both = new
    if older:
        old = read(older)
        if crossover is not None:
            old = stitched(old, crossover, new, "player_id", "stitched_id").withColumn("player_id", F.col("stitched_id")).drop("stitched_id")
        both = new.unionByName(old)
    return both.select("player_id", F.col("player_name").alias("name"), F.upper(F.trim("position")).alias("position"), int_or_null("season").alias("season"), F.coalesce(F.nullif(F.trim("season_type"), F.lit("")), F.lit("REG")).alias("season_type"), "recent_team", *(F.col(c).try_cast("double").alias(c) for c in stats))


def players(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Player files in turn as one dimension, see `player_dimension`; columns are those of any file."""
    files = [spark.read.option("header", True).csv(p).withColumn("order", F.monotonically_increasing_id()) for p in paths]
    return player_dimension(files, "gsis_id", "position")


def crosswalk(spark: SparkSession, path: str, ids: Sequence[str] = ("ktc_id", "mfl_id"), found: str = "gsis_id", name: str = "merge_name") -> dict[str, DataFrame]:
    """A crosswalk file as lookups: one for each id (the last row wins), one for the name and position (the first wins)."""
    rows = spark.read.option("header", True).csv(path).withColumn("order", F.monotonically_increasing_id())
    if missing := [c for c in (found, *ids) if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return crosswalk_maps(rows, found, list(ids), name)


def inches(x: Column) -> Column:
    """A height as feet-inches, or in inches."""
    x = F.trim(x)
    feet = F.substring_index(x, "-", 1).try_cast("double")
    rest = F.regexp_replace(x, "^[^-]*-", "").try_cast("double")
    return F.when(x.contains("-"), feet * 12.0 + rest).otherwise(x.try_cast("double"))


def combine(spark: SparkSession, path: str, measures: Sequence[str] = ("wt", "forty", "bench", "vertical", "broad_jump", "cone", "shuttle")) -> DataFrame:
    """Measurements of skill players, fullbacks as running backs, heights in inches; what is no number is null."""
    rows = spark.read.option("header", True).csv(path)
    pos = F.upper(F.trim("pos"))
    have = [(F.col(c) if c in rows.columns else F.lit(None).cast("string")).try_cast("double").alias(c) for c in measures]
    out = rows.where(pos.isin("QB", "RB", "FB", "WR", "TE"))
    others = [c for c in rows.columns if c not in ("pos", "ht", *measures)]
    return out.select(*others, F.when(pos == "FB", "RB").otherwise(pos).alias("pos"), inches(F.col("ht")).alias("ht"), *have)


def leagues(spark: SparkSession, path: str) -> DataFrame:
    """The leagues that a settings file lists: platform, league_id, year, league_format."""
    rows = spark.read.option("multiLine", True).schema("leagues array<struct<platform: string, league_id: string, year: int, league_format: string>>").json(path)
    return rows.select(F.inline("leagues")).where("platform is not null and league_id is not null").select("platform", "league_id", "year", F.coalesce("league_format", F.lit("sf_ppr")).alias("league_format"))
