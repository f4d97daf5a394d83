"""functions of the recorded-audio engine."""
