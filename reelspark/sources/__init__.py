"""sources of the recorded-audio engine."""
