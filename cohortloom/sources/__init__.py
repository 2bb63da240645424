"""Record, stage table and model sources and sinks."""
