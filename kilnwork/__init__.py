"""DataFrame operators for build-graph, content-store and training-data work on Spark."""
