"""kinetrail: pose and trajectory analytics as Spark DataFrame operators."""
