"""The same operators over Structured Streaming. State lives in Spark's state store or in Parquet tables."""
