"""plans of the recorded-audio engine."""
