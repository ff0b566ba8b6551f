"""eventmart: participation analytics as lazy PySpark DataFrame operators."""
