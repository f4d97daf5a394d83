"""operators of the recorded-audio engine."""
