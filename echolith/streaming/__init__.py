"""Streaming ingestion of audio files."""
