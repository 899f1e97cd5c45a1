"""Observatory: geolocated observation analytics as PySpark DataFrame operators.

Layout
------
``functions``   column expressions (no shuffles, no Python in the hot path)
``sources``     landed-record normalisers, readers and sinks
``operators``   DataFrame -> DataFrame operators
``streaming``   Structured Streaming forms of the batch operators
``plans``       the query catalogue over the test tables, with DuckDB twins
"""
