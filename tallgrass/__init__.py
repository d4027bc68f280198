"""tallgrass: a PySpark-native analytics engine for feature-matrix evidence pipelines."""
