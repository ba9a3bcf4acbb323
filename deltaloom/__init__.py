"""deltaloom: a PySpark-native analytics engine for batch, incremental and corpus queries."""
