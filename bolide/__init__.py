"""Trajectory analytics on Spark: linear tracks, encounters, matching, history."""
