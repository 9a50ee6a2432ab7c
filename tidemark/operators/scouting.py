"""College seasons, identities between eras and sources, and drafts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def qualifies(least: Mapping[str, float]) -> Column:
    """Whether any stat reaches its bar; a missing stat does not."""
    out = F.lit(False)
    for stat, bar in least.items():
        out = out | F.coalesce(F.col(stat) >= F.lit(bar), F.lit(False))
    return out


def over_threshold(rows: DataFrame, stat_of: Mapping[str, str], bar: float, keys: Sequence[str] = ("player", "position")) -> DataFrame:
    """Careers whose sum of the position's stat reaches the bar."""
    value = F.coalesce(*(F.when(F.col("position") == p, F.col(s).cast("double")) for p, s in stat_of.items()))
    return rows.groupBy(*keys).agg(F.sum(F.coalesce(value, F.lit(0.0))).alias("volume")).where(F.col("volume") >= bar)


def stitched(rows: DataFrame, mapping: DataFrame, later: DataFrame, key: str, out: str = "resolved") -> DataFrame:
    """Ids of an old era rewritten by `mapping` (old, new), but only to ids that the later era has."""
    m = mapping.join(later.select(F.col(key).alias("new")).distinct(), "new", "left_semi").select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    return rows.join(m, F.col(key) == F.col("_old"), "left").withColumn(out, F.coalesce("_new", key)).drop("_old", "_new")


def synthetic_keys(meta: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows again under prefix + key, where that key is free."""
    again = meta.withColumn(key, F.concat(F.lit(prefix), F.col(key)))
    return meta.unionByName(again.join(meta.select(key), key, "left_anti"))


def overlaid_dates(base: DataFrame, overrides: DataFrame, key: str, date: str) -> DataFrame:
    """A date is overlaid only where it is missing or not whole."""
    o = overrides.select(key, F.col(date).alias("_over"))
    keep = F.length(date) >= 10
    return base.join(o, key, "left").withColumn(date, F.when(keep, F.col(date)).otherwise(F.coalesce("_over", date))).drop("_over")


def overlaid_pages(base: DataFrame, pages: DataFrame, keys: Sequence[str], stats: Sequence[str], taken: str) -> DataFrame:
    """Pages fill what is missing and add unseen keys; the column `taken` is theirs where they have it."""
    p = pages.select(*keys, *(F.col(c).alias(f"_p_{c}") for c in [*stats, taken]))
    j = base.join(p, list(keys), "full_outer")
    return j.select(*keys, *(F.coalesce(c, f"_p_{c}").alias(c) for c in stats), F.coalesce(f"_p_{taken}", taken).alias(taken))


def coverage(rows: DataFrame, resolved: str, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col(resolved).isNotNull().cast("double")).alias("covered"))


def name_bridge(rows: DataFrame, candidates: DataFrame, keys: Sequence[str], school: str, college: str, found: str, order: str, either: bool = True) -> DataFrame:
    """The one candidate of a name, or of several the first whose college and the row's school hold
    each other (without `either`, whose college holds the school); else none.

    Candidates become one per name and college, and rows one per name and school, before they meet,
    so the pairs of a name are those of its schools and colleges, however many share it."""
    text = lambda c: F.lower(F.trim(c))
    first = F.min(F.struct(F.col(order).alias("_order"), F.col(found).alias("_found")))
    alone = candidates.groupBy(*keys).agg(F.count("*").alias("_n"), first.alias("_f")).where("_n = 1").select(*keys, F.col("_f._found").alias("_alone"))
    by_college = candidates.groupBy(*keys, text(college).alias("_college")).agg(first.alias("_f")).where("_college <> ''")
    schools = rows.select(*keys, text(school).alias("_school")).distinct().where("_school <> ''")
    hold = F.col("_college").contains(F.col("_school"))
    if either:
        hold = hold | F.col("_school").contains(F.col("_college"))
    hits = schools.join(by_college, list(keys)).where(hold).groupBy(*keys, "_school").agg(F.min("_f").alias("_hit"))
    j = rows.withColumn("_school", text(school)).join(alone, list(keys), "left").join(hits, [*keys, "_school"], "left")
    return j.select(*rows.columns, F.coalesce("_alone", "_hit._found").alias("resolved"))


def draft_match(picks: DataFrame, corpus: DataFrame, keys: Sequence[str], most: int = 2) -> DataFrame:
    """For each pick the row of the corpus with its keys whose last season is nearest to the year before
    the draft, the later one of two; none beyond `most` seasons.

    Of namesakes with one last season the least stands for all, and it is offered to the years around
    once, so a pick meets one row of the corpus, not every namesake."""
    one = corpus.groupBy(*keys, "last_season").agg(F.min("player").alias("_player"))
    near = one.select(*keys, "last_season", "_player", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("_d"))
    offer = F.struct(F.abs("_d").alias("gap"), (-F.col("last_season")).alias("late"), F.col("_player").alias("player"))
    near = near.groupBy(*keys, (F.col("last_season") + F.col("_d") + 1).alias("year")).agg(F.min(offer).alias("_b"))
    return picks.join(near, [*keys, "year"], "left").select(*picks.columns, F.col("_b.player").alias("matched"), F.col("_b").isNotNull().alias("corpus_match"))


def draft_enrich(rows: DataFrame, picks: DataFrame, keys: Sequence[str], year: str, columns: Sequence[str]) -> DataFrame:
    """Columns of the last pick of each key, if it is of the row's own class."""
    last = picks.groupBy(*keys).agg(F.max_by(F.struct("year", *columns), F.struct("year", *columns)).alias("_p"))
    j = rows.join(last, list(keys), "left")
    own = F.col("_p.year") == F.col(year)
    return j.select(*rows.columns, *(F.when(own, F.col(f"_p.{c}")).alias(c) for c in columns))


def class_order(rows: DataFrame, by: str, pick: str, score: str, name: str) -> DataFrame:
    """Place within the class: by pick (none last), then score, then name."""
    w = Window.partitionBy(by).orderBy(F.col(pick).asc_nulls_last(), F.desc(score), name)
    return rows.withColumn("place", F.row_number().over(w))


def by_priority(tiers: Sequence[DataFrame], key: str, order: str, most: int) -> DataFrame:
    """The first `most` keys: those of the first tier in their order, then of the next that are new."""
    both = tiers[0].select(key, order, F.lit(0).alias("tier"))
    for k, t in enumerate(tiers[1:], 1):
        both = both.union(t.select(key, order, F.lit(k).alias("tier")))
    one = both.groupBy(key).agg(F.min(F.struct("tier", order)).alias("_f")).select(key, "_f.*")
    return one.orderBy("tier", order, key).limit(most)


def college_points(row: Mapping[str, str], quarterback: Column) -> Column:
    """Points per game; 0 without games.  `row` names the columns of the eight stats and of games."""
    v = lambda k: F.coalesce(F.col(row[k]).cast("double"), F.lit(0.0))
    passer = F.lit(0.04) * v("pass_yds") + F.lit(4.0) * v("pass_td") + F.lit(0.1) * v("rush_yds") + F.lit(6.0) * v("rush_td") - F.lit(2.0) * v("int_thrown")
    other = F.lit(0.1) * v("rush_yds") + F.lit(6.0) * v("rush_td") + v("rec") + F.lit(0.1) * v("rec_yds") + F.lit(6.0) * v("rec_td")
    return F.when(v("games") <= 0, 0.0).otherwise(F.when(quarterback, passer).otherwise(other) / v("games"))


def college_age(class_year: Column, last: Column, first: Column, freshman: float = 19.0) -> tuple[Column, Column]:
    """(age at the last season, whether it is inferred): by class, else by seasons since the first."""
    order = F.array_position(F.array(*(F.lit(c) for c in ("FR", "SO", "JR", "SR"))), F.upper(F.trim(class_year)))
    known = F.coalesce(order > 0, F.lit(False))
    return F.when(known, F.lit(freshman) + (order - 1)).otherwise((last - first).cast("double") + F.lit(freshman)), ~known


def inferred_position(tables: Column, attempts: Column, rushes: Column, receptions: Column) -> Column:
    """From the tables in which a player stands: a passer needs 50 attempts."""
    has = lambda t: F.array_contains(tables, t)
    both = F.when(F.coalesce(rushes, F.lit(0)) >= 2 * F.coalesce(receptions, F.lit(0)), "RB").otherwise("WR")
    return F.when(has("passing") & (F.coalesce(attempts, F.lit(0)) >= 50), "QB").when(has("rushing") & has("receiving"), both).when(has("rushing"), "RB").when(has("receiving"), "WR")
