"""ctxspark.operators"""
