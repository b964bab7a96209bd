"""tessella: a Spark-first analytics engine for the data around language-model applications."""

__version__ = "0.1.0"
