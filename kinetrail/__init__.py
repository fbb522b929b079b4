"""kinetrail: particle-trajectory analytics expressed as Spark DataFrames."""
