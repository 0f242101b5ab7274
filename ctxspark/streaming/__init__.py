"""ctxspark.streaming"""
