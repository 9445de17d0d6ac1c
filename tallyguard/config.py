"""Parameters of the detection layers.

Every operator takes these as keyword arguments; the values here are defaults.
"""

from __future__ import annotations

# --- fixed values: thresholds and lists that define the results ----------------
REPORTING_THRESHOLD = 10_000
BAND_LOW = 0.70
BURST_DAYS = 7
BURST_MIN_COUNT = 3
PASS_HOURS = 24
PASS_SHARE = "0.80"  # text, so that it becomes an exact decimal
PASS_MIN_AMOUNT = 1_000
ROUND_MIN_AMOUNT = 1_000
HIGH_RISK_COUNTRIES = ("Cyprus", "Malta", "Seychelles", "Panama", "Cayman Islands")
COUNTRY_SPELLINGS = {
    "united states": "United States",
    "us": "United States",
    "usa": "United States",
    "u.s.a.": "United States",
    "u.s.": "United States",
    "united states of america": "United States",
    "united kingdom": "United Kingdom",
    "uk": "United Kingdom",
    "u.k.": "United Kingdom",
    "great britain": "United Kingdom",
    "gb": "United Kingdom",
}
RULES = ("structuring", "rapid_movement", "high_risk_country", "round_amount")
TIER_A = ("structuring", "rapid_movement")
TIER_B = ("high_risk_country", "round_amount")
SWEEP = (0.50, 0.75, 0.80, 0.90, 0.95, 0.975, 0.99, 0.995, 0.999)
TIER_B_PERCENTILE = 0.99
ANOMALY_ONLY_PERCENTILE = 0.999
HOURS_PER_ALERT = 0.25
ALERT_BUDGET = 228
LARGE_AMOUNT = 50_000
MIN_HISTORY = 5
CHAIN_HOURS = 24
CHAIN_TOLERANCE = "0.15"
FUNNEL_MIN_SENDERS = 3
TREES = 300
TREE_ROWS = 4_096
SEED = 42
NEIGHBOURS = 35

# --- units ---------------------------------------------------------------------
SECOND = 1_000_000  # microseconds
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR
