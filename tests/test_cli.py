"""The commands, over the smallest tables."""

import os

import pytest

from tidemark import cli

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def said(capsys, *argv):
    code = cli.main([str(x) for x in argv])
    return code, capsys.readouterr().out


def test_listings(spark, capsys):
    assert "q_rank_tier" in said(capsys, "list")[1] and "draft_lines: Draft picks" in said(capsys, "sources")[1]
    assert "league_format = sf_ppr" in said(capsys, "settings")[1]
    assert said(capsys, "run", "q_none", DIR)[0] == 2
    with pytest.raises(SystemExit):
        cli.main(["nonsense"])


def test_queries(spark, capsys, tmp_path):
    assert "Scan parquet" in said(capsys, "explain", "q_scan_filter", DIR)[1]
    assert said(capsys, "run", "q_scan_filter", DIR, "--out", tmp_path / "o") == (0, "")
    out = said(capsys, "inspect", tmp_path / "o")[1]
    assert "player" in out and "double" in out
    (tmp_path / "x.csv").write_text("a,b\n1,\n2,y\n")
    assert [line.split("|")[1:5] for line in said(capsys, "inspect", tmp_path / "x.csv")[1].splitlines() if "|a" in line or "|b" in line] == [["a     ", "string", "2   ", "0    "], ["b     ", "string", "2   ", "1    "]]


def test_ranks(spark, capsys):
    rows = [line for line in said(capsys, "top", DIR, "--n", 5, "--position", "BUILDING")[1].splitlines() if "BUILDING" in line]
    places = [int(r.split("|")[4]) for r in rows]
    assert len(rows) == 5 and places == sorted(places)
    assert said(capsys, "top", DIR, "--n", 3, "--format", "2qb")[1].count("|2qb") == 3
    assert said(capsys, "score", DIR, "--format", "std", "--n", 4)[1].count("|std") == 4


def test_leagues_and_backtests(spark, capsys, tmp_path):
    assert "power_rank" in said(capsys, "league", DIR, "--n", 3)[1] and "skill_rank" in said(capsys, "managers", DIR)[1]
    for k in (1, 2):
        said(capsys, "backtest", DIR, "--record", tmp_path / "r")
        assert spark.read.parquet(str(tmp_path / "r")).count() == k
    assert "projected_career" in said(capsys, "prospects", DIR, "--n", 2)[1]
    assert said(capsys, "snapshot", tmp_path / "none") == (1, "nothing there\n")
