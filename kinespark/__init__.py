"""kinespark: integrity checks for robot-learning data, as Spark queries."""

__version__ = "0.1.0"
