"""Analytics over typed outcome records of reinforcement-learning work, as Spark DataFrames."""
