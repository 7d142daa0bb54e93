"""Boundary cases, signals, calibration and grouped uncertainty as Spark jobs."""
