"""emberfield: satellite thermal-detection analytics as PySpark DataFrame operators."""
