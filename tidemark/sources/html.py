"""What HTML pages hold: tables, boards, and single fields, on top of `elements`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import elements


def plain(x: Column) -> Column:
    """Text without tags, with the common entities."""
    y = F.regexp_replace(x, r"<[^>]+>", "")
    for name, letter in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        y = F.replace(y, F.lit(name), F.lit(letter))
    return F.trim(y)


def closed_references(x: Column) -> Column:
    """Text with the five common references read where a semicolon ends them; others stay as they are."""
    for name, letter in (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(letter))
    return F.trim(x)


def table_rows(pages: DataFrame, html: str, table_id: str, keep_first: str | None = None) -> DataFrame:
    """A row for each body row of the table, its cells as a map from data-stat to text; row_id is what a
    cell's data-append-csv says, and rows without one, as those that repeat the head, are left out.

    The table may be in a comment, and tables within its cells are not taken for its rows.  Of several
    tables with the id the first of a page counts.  With keep_first (a stat), of a page's rows with one
    value of it the first stays."""
    own = [c for c in pages.columns if c != html]
    page = pages.select(F.struct(*(F.col(f"`{c}`") for c in own), F.lit(0).alias("_")).alias("_own"), F.monotonically_increasing_id().alias("_page"), F.col(f"`{html}`").alias("_html"))
    found = elements.elements(page, "_html", tags=("table", "tr", "td", "th"))
    at = Window.partitionBy("_page")  # a page is bounded
    wanted = F.min(F.when((F.col("tag") == "table") & (F.col("attrs")["id"] == table_id), F.col("no"))).over(at)
    found = found.withColumn("_table", wanted).where((F.col("table_no") == F.col("_table")) & ~F.coalesce("section", F.lit("")).isin("thead", "tfoot"))
    head = F.max(F.when(F.col("tag") == "tr", F.array_contains("classes", "thead"))).alias("_head")
    cell = F.col("tag").isin("td", "th") & (F.col("attrs")["data-stat"] != "")
    cells = F.array_sort(F.collect_list(F.when(cell, F.struct("no", F.col("attrs")["data-stat"].alias("stat"), F.coalesce("text", F.lit("")).alias("text"), F.col("attrs")["data-append-csv"].alias("id")))))
    rows = found.where("row_no is not null").groupBy("_page", "row_no").agg(F.any_value("_own").alias("_own"), head, cells.alias("_cells")).where("not _head")
    last = F.array_compact(F.transform("_cells", lambda c: F.nullif(c["id"], F.lit(""))))
    stats = F.aggregate("_cells", F.create_map().cast("map<string,string>"), lambda m, c: F.map_concat(F.map_filter(m, lambda k, _: k != c["stat"]), F.create_map(c["stat"], c["text"])))
    rows = rows.where(F.size(last) > 0).select("_page", "row_no", "_own", F.element_at(last, -1).alias("row_id"), stats.alias("cells"))
    if keep_first:
        w = Window.partitionBy("_page", F.col("cells")[keep_first]).orderBy("row_no")
        rows = rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return rows.select(*(F.col(f"_own.`{c}`").alias(c) for c in own), "row_id", "cells")


def player_name(x: Column) -> Column:
    """A name without the marks of honours behind it."""
    return F.trim(F.regexp_replace(F.trim(x), r"[*+]+$", ""))


def season_rows(pages: DataFrame, html: str, table: str, season: str) -> DataFrame:
    """A season's table: id, player_name, team, season, table and all cells."""
    rows = table_rows(pages, html, table)
    text = lambda k: F.nullif(F.col("cells")[k], F.lit(""))
    return rows.select(F.col("row_id").alias("id"), player_name(F.coalesce(text("name_display"), text("player"), F.lit(""))).alias("player_name"), F.coalesce(text("team_name_abbr"), text("team"), F.lit("")).alias("team"), F.col(season).alias("season"), F.lit(table).alias("table"), "cells")


def draft_rows(pages: DataFrame, html: str, year: str, table: str = "drafts") -> DataFrame:
    """A draft class: pick, round, team, player, position, college and the id, in the order of picks."""
    rows = table_rows(pages, html, table)
    number = lambda k: F.col("cells")[k].try_cast("int")
    return rows.select(F.col(year).alias("year"), number("draft_round").alias("round"), number("draft_pick").alias("pick"), F.col("cells")["team"].alias("team"), F.col("row_id").alias("id"), player_name(F.col("cells")["player"]).alias("player_name"), F.col("cells")["pos"].alias("position"), F.nullif(F.col("cells")["college_id"], F.lit("")).alias("college"), number("age").alias("age")).where("pick is not null")


BOARD = ("mock-row", "mock-row-pick-number", "mock-row-name", "mock-row-school-position")


def big_board(pages: DataFrame, html: str, current_year: int) -> DataFrame:
    """A board of prospects: rank, name, position, school, college_slug, height, weight, draft_year.

    A row of the present class has its rank; one of a later class has the year in the rank's place (or no
    number: then it is the next class) and rank -1.  Of a page's rows with one name and school, whatever
    their case, the first stays, so the overall rank wins over lists further down."""
    own = [c for c in pages.columns if c != html]
    page = pages.select(F.struct(*(F.col(f"`{c}`") for c in own), F.lit(0).alias("_")).alias("_own"), F.monotonically_increasing_id().alias("_page"), F.col(f"`{html}`").alias("_html"))
    e = elements.elements(page, "_html", tags=("a", "div"), classes=BOARD)
    in_page = Window.partitionBy("_page").orderBy("no")  # a page is bounded
    row = F.when(F.array_contains("classes", "mock-row") & F.array_contains("classes", "nfl"), F.struct("no", "end_no", "classes", F.col("attrs")["data-pos"].alias("position")))
    e = e.withColumn("_row", F.last(row, ignorenulls=True).over(in_page)).where("no <= _row.end_no")
    first = lambda x, when=None: F.min_by(x, F.when(x.isNotNull() if when is None else when, F.col("no")))
    part = lambda c: first(F.col("text"), F.array_contains("classes", c) & F.col("text").isNotNull())
    slug = F.nullif(F.regexp_extract(F.when(F.col("tag") == "a", F.col("attrs")["href"]), r"^/nfl/colleges/([a-z0-9-]+)", 1), F.lit(""))
    plain_div = (F.col("tag") == "div") & (F.size("classes") == 0)
    g = e.groupBy("_page", "_row").agg(
        F.any_value("_own").alias("_own"), part("mock-row-pick-number").alias("label"), part("mock-row-name").alias("name"), part("mock-row-school-position").alias("line"),
        first(slug).alias("college_slug"),
        first(F.col("text"), plain_div & F.col("text").rlike("^[0-9]+'[0-9]+")).alias("tall"),
        first(F.col("text"), plain_div & F.col("text").rlike("^[0-9]+$")).alias("heavy"),
    )
    later, number = F.array_contains("_row.classes", "future"), F.col("label").try_cast("int")
    school = F.nullif(F.trim(F.regexp_extract("line", r"\|(.*)$", 1)), F.lit(""))
    height = F.concat(F.nullif(F.regexp_extract("tall", "^([0-9]+'[0-9]+)", 1), F.lit("")), F.lit('"'))
    g = g.where("name is not null").select(
        "_page", F.col("_row.no").alias("_no"), *(F.col(f"_own.`{c}`").alias(c) for c in own),
        F.when(later, -1).otherwise(F.coalesce(number, F.lit(-1))).alias("rank"), "name", F.col("_row.position").alias("position"), school.alias("school"), "college_slug",
        height.alias("height"), F.when(height.isNotNull(), F.col("heavy").try_cast("int")).alias("weight"),
        F.when(later, F.coalesce(number, F.lit(current_year + 1))).otherwise(current_year).alias("draft_year"),
    )
    same = Window.partitionBy("_page", F.lower("name"), F.lower(F.coalesce("school", F.lit("")))).orderBy("_no")
    return g.withColumn("_rn", F.row_number().over(same)).where("_rn = 1").drop("_rn", "_page", "_no")


def birth_date(html: Column) -> Column:
    """From the marked span, else from the text."""
    marked = F.nullif(F.regexp_extract(html, r'data-birth="(\d{4}-\d{2}-\d{2})"', 1), F.lit(""))
    return F.coalesce(marked, F.nullif(F.regexp_extract(html, r"[Bb]orn:?\s*(\d{4}-\d{2}-\d{2})", 1), F.lit(""))).try_cast("date")


def page_title(html: Column) -> Column:
    head = F.nullif(plain(F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1)), F.lit(""))
    return F.coalesce(head, F.nullif(plain(F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1)), F.lit("")))
