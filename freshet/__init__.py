"""Freshet: flood early-warning analytics as Spark jobs.

Station discharge, rainfall, soil moisture, vegetation, terrain and flood-impact
records become one (district, station, day) panel; the operators derive features,
event blocks, thresholds, classifiers and skill scores from it.
"""
