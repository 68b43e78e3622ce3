"""Media-catalog analytics and training-data operators, expressed as PySpark plans."""
