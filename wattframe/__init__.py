"""wattframe: household electricity-readings analytics as Spark DataFrames.

``functions``  Column -> Column cleaning rules
``sources``    scans, contracts, sinks, the live feed and the report log
``operators``  DataFrame -> DataFrame filters, aggregates, rankings, alerts, scoring
``streaming``  the live feed as Structured Streaming queries
``plans``      whole builds (mining, dashboard) and the registered queries
"""
