"""talkmine: batch and streaming jobs over time-coded talk recordings."""
