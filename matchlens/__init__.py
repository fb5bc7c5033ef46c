"""Spark-native analytics for team-versus-team match data (one row per player per game)."""

__version__ = "0.1.0"
