"""quarry: a PySpark-native library of table, text, vector, raster, graph
and model operators. Every operator is a plain function from DataFrame(s)
to a DataFrame, so Catalyst sees one declarative plan per job."""

__version__ = "0.1.0"
