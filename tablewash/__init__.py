"""tablewash: profiling, cleaning and converting tables with Spark DataFrames.

Layout:
  functions/  column expressions (missing-value tests, Unicode trim, title case,
              strict parsing of model replies)
  operators/  DataFrame -> DataFrame steps (profile, clean, casts, ordering,
              statistics, union, sort)
  plans/      composed jobs: the cleaning recipe, the before/after report and the
              free-text extraction job
  sources/    file census, CSV / JSON / workbook readers, key detection
  sinks/      CSV, Parquet, tables, JDBC, JSON documents, reports
  streaming/  the row-wise part of a recipe on a streaming DataFrame
"""

__version__ = "0.1.0"
