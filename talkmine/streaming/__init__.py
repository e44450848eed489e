"""streaming of talkmine."""
