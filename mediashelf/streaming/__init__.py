"""The same jobs run on streams, one micro-batch at a time."""
