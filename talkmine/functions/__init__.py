"""functions of talkmine."""
