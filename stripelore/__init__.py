"""Reading, inspecting and decoding ORC files with Spark."""
