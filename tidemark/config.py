"""Settings of a session: fields with defaults, set by `spark.conf` under the prefix tidemark."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX = "tidemark."
YES, NO = ("true", "yes", "1"), ("false", "no", "0")


@dataclass(frozen=True)
class Settings:
    first_season: int = 1999
    current_season: int | None = None
    league_format: str = "sf_ppr"
    neighbours: int = 25
    least_rows: int = 1
    least_share: float = 0.5
    full_refresh: bool = False
    data_dir: str | None = None


def settings(spark: SparkSession, **given) -> Settings:
    """What the session sets, over the defaults, and what is given here over both.  Empty values count as unset; names
    that are no field are passed over in the session, and are an error here."""
    held = {}
    for f in fields(Settings):
        text = (spark.conf.get(PREFIX + f.name, "") or "").strip()
        if not text:
            continue
        kind = str(f.type).split(" ")[0]
        if kind == "bool":
            if text.lower() not in YES + NO:
                raise ValueError(f"{PREFIX}{f.name} is {text!r}, not true or false")
            held[f.name] = text.lower() in YES
        else:
            held[f.name] = {"int": int, "float": float}.get(kind, str)(text)
    return Settings(**(held | given))
