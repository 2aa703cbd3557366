"""Climate, station and document data processing on Spark DataFrames.

The core holds sources, column functions, operators and query plans; the
subpackage ``llm`` holds the operators for text corpora and free-entered
records, and nothing in the core imports it.
"""
