"""Data-popularity analytics as Spark DataFrame operators.

``functions``  column expressions (names, days, read bins, size metrics)
``sources``    record layouts and readers
``sinks``      writers and file layout
``operators``  DataFrame in, DataFrame out
``plans``      session settings and whole jobs that read and write stage directories
"""
