"""Analytics for model distillation, expressed as Spark DataFrame, SQL and ML plans."""
