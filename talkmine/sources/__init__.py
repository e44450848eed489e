"""sources of talkmine."""
