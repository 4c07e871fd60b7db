"""Page transcription and archive catalog work as Spark DataFrame functions."""
