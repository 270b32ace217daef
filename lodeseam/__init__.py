"""lodeseam: source-retrieval analytics as PySpark DataFrame plans."""
