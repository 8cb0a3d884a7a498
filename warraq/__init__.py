"""warraq: text analytics, retrieval and measurement as Spark DataFrame operators."""
