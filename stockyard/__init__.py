"""stockyard: an equity-analytics warehouse on Spark DataFrames.

Layers:
  functions/  Column-in / Column-out helpers (rounding, indicators, names, text)
  sources/    readers: the derived star over the driver tables, CSV ingest
  operators/  dimensional load, key handling, quality gates, retrieval, schema evolution
  plans/      analytic views, analysis API, load flows
  streaming/  file-stream wrapper around the daily load
"""

__version__ = "0.1.0"
