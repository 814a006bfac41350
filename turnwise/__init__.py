"""Turn analytics on Spark: frames and segments into sessions and turns, text rules, matching, exports."""
