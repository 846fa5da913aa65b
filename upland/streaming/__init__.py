"""Report queue: batch rules and the Structured Streaming jobs that call them."""
