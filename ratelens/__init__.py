"""ratelens: rate-distortion and measurement analytics on PySpark."""
