"""Fund-holdings analytics as composable Spark DataFrame operators."""
