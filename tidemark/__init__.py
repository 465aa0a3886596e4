"""tidemark: event-stream and keyed-table analytics written as PySpark DataFrame, SQL and Structured Streaming code."""
