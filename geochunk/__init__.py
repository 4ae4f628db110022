"""geochunk: a PySpark-native engine for raw map elements (nodes, ways, relations).

Everything is expressed as lazy ``DataFrame -> DataFrame`` functions; see README.md.
"""
