"""Cross-sectional factor research on Spark: a typed expression language, point-in-time panels, and evaluation."""
