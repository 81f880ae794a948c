"""Trajectory analytics on PySpark: map matching, recovery, traffic lights, speed features and rating."""
