"""streaming of the recorded-audio engine."""
