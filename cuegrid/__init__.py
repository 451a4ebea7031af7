"""cuegrid: timed-text and annotation operators over Spark DataFrames."""
