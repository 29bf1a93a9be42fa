"""Entity matching and match-graph cleaning as composable Spark DataFrame operators."""

__version__ = "0.1.0"
