"""Quern: a PySpark-native engine for grounded facts.

Facts taken from pages are normalised, gated, reconciled across documents and
reshaped, all as DataFrame plans. Sub-packages:

* ``functions``  column expressions (text, values, time, similarity, intervals)
* ``operators``  DataFrame -> DataFrame operators
* ``sources``    readers, schemas and the fact store
* ``streaming``  Structured Streaming versions
* ``plans``      the named queries and their SQL twins
* ``llm``        operators for training-data pipelines (optional; nothing above imports it)
"""
