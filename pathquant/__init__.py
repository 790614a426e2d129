"""PySpark-native engine for probabilistic path quantification."""
