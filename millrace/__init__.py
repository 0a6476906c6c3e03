"""Spark-native data jobs: readers, writers, operators, models and streams.

Every public function takes DataFrames (or a session and a path) and returns a
lazy DataFrame; nothing here gathers table rows on the driver.
"""
