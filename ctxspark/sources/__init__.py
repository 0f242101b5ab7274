"""ctxspark.sources"""
