"""lexiflow: vocabulary, n-gram, completion and correction analytics on Spark DataFrames."""

__version__ = "0.1.0"
