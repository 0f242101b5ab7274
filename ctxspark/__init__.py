"""ctxspark: LLM-context analytics and corpus preparation on PySpark."""
