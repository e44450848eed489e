"""operators of talkmine."""
