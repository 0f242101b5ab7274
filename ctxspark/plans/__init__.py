"""ctxspark.plans"""
