"""Spark jobs for daily outage observations kept at nested grains."""
