"""Rows that the operators of a run plan gave out, and what a plan shuffles."""


def collected(spark, df):
    """The rows of ``df``, and the largest number of rows that any of its joins gave out."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        todo += [node.children().apply(k) for k in range(node.children().size())]
        if "Join" in node.nodeName():
            most = max(most, node.metrics().apply("numOutputRows").value())
    return rows, most


def exchanged(df, column):
    """How many exchanges of ``df``'s plan hold a column of this name."""
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.initialPlan())
        todo += [node.children().apply(k) for k in range(node.children().size())]
        names = [node.output().apply(k).name() for k in range(node.output().size())]
        n += node.nodeName() == "Exchange" and column in names
    return n
