"""Diarization of live audio: presets, the state of one stream, and the jobs that keep it."""
