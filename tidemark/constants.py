"""Fixed values that results depend on."""

# seasons and careers
MIN_SEASON, MIN_GAMES = 1980, 4
LONG_ARC_THROUGH, LONG_ARC_SEASONS, VETERAN_AGE, VETERAN_SEASONS = 2022, 8, 33, 6
SEASON_GAMES = 17
ERA_ENDS = (2004, 2014, 2019)

# career neighbours
CAREER_WEIGHTS = (2.0, 1.5, 1.0, 3.0, 4.0, 3.0, 0.8, 0.2, 0.3, 0.5, 5.0)
CAREER_SCALE, ROOKIE_SCALE = 20.0, 15.0
ROOKIE_WEIGHTS = {"rate": 8.0, "played": 0.1, "passing_yards_pg": 0.0005, "rushing_yards_pg": 0.003, "receiving_yards_pg": 0.003, "passing_tds_pg": 0.2, "rushing_tds_pg": 0.3, "receiving_tds_pg": 0.3, "completion_rate": 0.1, "age": 20.0}
NEIGHBOURS, ROOKIE_NEIGHBOURS = 25, 20
LIMITED_GAMES, ROOKIE_FULL_GAMES, ROOKIE_FLOOR, ROOKIE_COMPS_SHARE = 10, 8.0, 0.35, 0.70
ROOKIE_CAREER = (8.0, 0.80)
ROOKIE_CAREERS = {"QB": (8.0, 0.72), "RB": (8.5, 0.85), "WR": (9.5, 0.85), "TE": (9.0, 0.85)}
DISCOUNT = 0.05
OLD_HAIRCUT = 0.9
POSITION_BARS = {"QB": 18.0, "RB": 15.0, "WR": 16.0, "TE": 12.0}
BLEND_BAND, BLEND_COMPS, BLEND_CAP = 5.0, 3, 1.25

# penalties
BUST_AGE, BUST_SEASONS, SHORT_SEASONS = 30, 8, 5
CONFIDENCE_QB, CONFIDENCE_OTHER, CONFIDENCE_LOW, CONFIDENCE_CAP = 32.0, 30.0, 16, 0.5
STALE_GAMES = 12
FLOOR = 0.20
MISSED = (0.45, 0.70, 0.85, 8)

# lifts and their gates
DECLINE_AGE, DECLINE_SHARE = 27, 0.85
LATE_AGE, LATE_RATE = 30, 16.0

# prospects (fixed values)
CONFERENCE_FACTOR = {"P5": 1.00, "G5_top": 0.85, "G5": 0.75, "FCS": 0.65}
PROSPECT_WEIGHTS = {"z_avg": 3.0, "z_peak": 2.0, "z_final": 2.0, "stage": 1.0, "age": 20.0, "z_factor": 1.5}
PROSPECT_STAGES, PROSPECT_AGES, PROSPECT_COMPS, PROSPECT_VOLUME = 1, 2, 25, 200.0
FULL_COMPS = 8
ROUND_ENDS = ((10, "R1_top10"), (32, "R1"), (64, "R2"), (100, "R3"), (150, "R4"), (200, "R5_6"))
ROUND_POINTS = {
    "QB": {"R1_top10": 3200.0, "R1": 2200.0, "R2": 1100.0, "R3": 600.0, "R4": 320.0, "R5_6": 170.0, "R7": 85.0, "UDFA": 40.0},
    "RB": {"R1_top10": 1600.0, "R1": 1200.0, "R2": 780.0, "R3": 500.0, "R4": 320.0, "R5_6": 180.0, "R7": 95.0, "UDFA": 55.0},
    "WR": {"R1_top10": 1700.0, "R1": 1250.0, "R2": 820.0, "R3": 480.0, "R4": 300.0, "R5_6": 170.0, "R7": 85.0, "UDFA": 40.0},
    "TE": {"R1_top10": 900.0, "R1": 700.0, "R2": 520.0, "R3": 330.0, "R4": 210.0, "R5_6": 120.0, "R7": 60.0, "UDFA": 30.0},
}
ROUND_PEAK = {"R1_top10": 13.5, "R1": 11.0, "R2": 9.0, "R3": 7.5, "R4": 6.0, "R5_6": 4.5, "R7": 3.0, "UDFA": 2.0}
ROUND_YEARS = {"R1_top10": 7.5, "R1": 6.5, "R2": 5.5, "R3": 4.5, "R4": 3.5, "R5_6": 2.5, "R7": 1.8, "UDFA": 1.2}

# tables
TIER_ENDS = (12, 24, 48, 72, 108, 144, 200, 260)
PICK_TIERS = ((10, "R1_top10"), (32, "R1"), (64, "R2"), (100, "R3"), (150, "R4_5"), (200, "R6"))
SCORING = ("passing_yards", 0.04), ("passing_tds", 4.0), ("interceptions", -2.0), ("rushing_yards", 0.1), ("rushing_tds", 6.0), ("receptions", 1.0), ("receiving_yards", 0.1), ("receiving_tds", 6.0)
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")
