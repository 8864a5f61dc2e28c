"""Sources and sinks: audio files, synthetic impulse responses, record tables."""
