"""Operators on whole DataFrames: matching, splitting, counting, detections, containment, training logs."""
