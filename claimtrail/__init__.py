"""claimtrail — checkable evidence review as Spark DataFrame operators."""

__version__ = "0.1.0"
