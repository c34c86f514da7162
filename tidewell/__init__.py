"""Spark-native analytics for ensembles of hydraulic and hydrologic simulation results."""
