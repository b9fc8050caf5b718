"""Analytics over workflow-run history, written as Spark DataFrame operators."""

__version__ = "0.1.0"
