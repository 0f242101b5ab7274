"""ctxspark.functions"""
