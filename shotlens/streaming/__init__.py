"""Live forms of the batch plans on Structured Streaming."""
