"""Occupancy analytics over arrival/departure events, written as Spark DataFrame operators."""
