"""Scoring, eras, tiers, labels and other row-wise rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .numeric import clip, ladder


def era(season: Column | str, ends: Sequence[int] = C.ERA_ENDS) -> Column:
    return ladder(season, [(end, k + 1) for k, end in enumerate(ends)], len(ends) + 1)


def season_points(coefficients: Mapping[str, float], position: Column | None = None, bonus: Mapping[str, tuple[str, float]] | None = None) -> Column:
    """sum of stat * coefficient, missing counts as 0; bonus: position -> (stat, coefficient)."""
    out = F.lit(0.0)
    for stat, k in coefficients.items():
        out = out + F.coalesce(F.col(stat).cast("double"), F.lit(0.0)) * F.lit(float(k))
    for where, (stat, k) in (bonus or {}).items():
        out = out + F.when(position == where, F.coalesce(F.col(stat).cast("double"), F.lit(0.0)) * F.lit(float(k))).otherwise(F.lit(0.0))
    return out


def tier(rank: Column | str, ends: Sequence[int] = C.TIER_ENDS) -> Column:
    return ladder(rank, [(end, k + 1) for k, end in enumerate(ends)], len(ends) + 1)


def style(position: Column, rushing_per_game: Column, quarterback: str = "QB") -> Column:
    return F.when((position != quarterback) | (rushing_per_game < 15), "pocket").when(rushing_per_game < 30, "mobile").otherwise("dual")


def one_way_lift(value: Column, lift: Column) -> Column:
    return F.when(lift <= 1, value).otherwise(F.greatest(value, value * lift))


def breakout_bonus(points: Column) -> Column:
    return F.lit(1.0) + F.lit(0.3) * F.log2(F.lit(1.0) + F.greatest(points, F.lit(0.0)) / F.lit(1500.0))


def recency_bonus(season: Column, first: int = 2015, last: int = 2022, most: float = 0.25) -> Column:
    return F.lit(1.0) + F.lit(most) * clip((season - F.lit(first)) / F.lit(float(last - first)), 0.0, 1.0)


def schedule_adjusted(points: Column, z: Column) -> Column:
    return points * clip(F.lit(1.0) + F.lit(0.15) * F.coalesce(z, F.lit(0.0)), 0.65, 1.10)


def expected_at_pick(pick: Column) -> Column:
    return F.when(pick <= 0, 100.0).when(pick > 250, 0.0).otherwise(F.lit(100.0) * (F.lit(1.0) - (pick - 1) / F.lit(250.0)))


def pick_tier(pick: Column, tiers=C.PICK_TIERS) -> Column:
    return F.when(pick.isNull(), "UDFA").otherwise(ladder(pick, tiers, "R7"))


def hit_label(peak: Column, seasons: Column) -> Column:
    return F.when(peak >= 18, "elite").when(peak >= 12, "starter").when((seasons >= 3) & (peak < 6), "bust").otherwise("unknown")


def weight_of_correlation(rho: Column) -> Column:
    r = F.abs(rho)
    return F.when(rho.isNull(), 1.0).when(r >= 0.35, 1.5).when(r >= 0.25, 1.25).when(r >= 0.15, 1.0).otherwise(0.5)


def conference_tier(conference: Column, season: Column) -> Column:
    """Season-aware tiers: one conference fell in 2013, another rose for six years."""
    return (
        F.when(conference.isin("ACC", "Big Ten", "Big 12", "Pac-12", "Pac-10", "SEC"), "P5")
        .when(conference == "Big East", F.when(season <= 2012, "P5").otherwise("G5_top"))
        .when(conference == "WAC", F.when(season.between(2007, 2012), "G5_top").otherwise("G5"))
        .when(conference.isin("American", "MWC"), "G5_top")
        .when(conference.isin("Ind", "Sun Belt", "MAC", "CUSA"), "G5")
        .otherwise("FCS")
    )


# fixed values: position labels and what they count as, conferences' short names, and tiers by full name
POSITIONS = {"QB": "QB", "RB": "RB", "HB": "RB", "FB": "RB", "TB": "RB", "WR": "WR", "FL": "WR", "SE": "WR", "SL": "WR", "WB": "WR", "TE": "TE"}
LEADING = {"RB": "RB", "HB": "RB", "FB": "RB", "WR": "WR", "FL": "WR", "SE": "WR", "TE": "TE", "QB": "QB"}
CONFERENCES = {"American": "American Athletic", "CUSA": "Conference USA", "MAC": "Mid-American", "MWC": "Mountain West", "Ind": "FBS Independents"}
CONFERENCE_TIERS = {
    "P5": ["ACC", "Big 12", "Big East", "Big Ten", "Pac-10", "Pac-12", "SEC", "FBS Independents"],
    "G5_top": ["American Athletic", "Mountain West", "Sun Belt"],
    "G5": ["Conference USA", "Mid-American", "WAC", "Big West"],
    "FCS": ["Big Sky", "Big South", "CAA", "FCS Independents", "Ivy", "MEAC", "MVFC", "NEC", "OVC", "Patriot", "Pioneer", "SWAC", "Southern", "Southland", "UAC"],
}


def _literal_map(pairs: Mapping[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def any_position(label: Column) -> Column:
    """The first part of a label such as "QB/WR" that is a skill position, else null."""
    parts = F.split(F.upper(F.trim(label)), r"[/\\,\s]+")
    found = F.filter(F.transform(parts, lambda p: F.try_element_at(_literal_map(POSITIONS), p)), lambda p: p.isNotNull())
    return F.try_element_at(found, F.lit(1))


def first_position(label: Column) -> Column:
    """The first part of a label only."""
    return F.try_element_at(_literal_map(LEADING), F.try_element_at(F.split(F.upper(F.trim(label)), r"[/,\-\s]"), F.lit(1)))


def canonical_tier(conference: Column) -> Column:
    """By the conference's full name, without its division; null if unknown."""
    short = F.trim(F.regexp_replace(conference, r"\(.*$", ""))
    full = F.coalesce(F.try_element_at(_literal_map(CONFERENCES), short), short)
    return F.try_element_at(_literal_map({c: t for t, cs in CONFERENCE_TIERS.items() for c in cs}), full)


def comp_label(points: Column, name: Column) -> Column:
    tier_ = F.when(points >= 1800, "elite").when(points >= 1100, "above-avg").when(points >= 600, "starter").otherwise("deep")
    return F.concat(tier_, F.lit(" ("), name, F.lit(")"))


def first_int(*columns: str) -> Column:
    """The first column that converts to a whole number."""
    return F.coalesce(*(F.col(c).cast("string").try_cast("double").try_cast("int") for c in columns))


def age_at(day: Column, birth: Column) -> Column:
    """Whole years, counting the birthday itself."""
    return F.year(day) - F.year(birth) - F.when(F.date_format(day, "MMdd") < F.date_format(birth, "MMdd"), 1).otherwise(0)


def season_of(day: Column) -> Column:
    return F.year(day) - F.when(F.month(day) >= 9, 0).otherwise(1)


def height_inches(x: Column) -> Column:
    parts = F.split(x, "-")
    return F.try_element_at(parts, F.lit(1)).try_cast("int") * 12 + F.try_element_at(parts, F.lit(2)).try_cast("int")
