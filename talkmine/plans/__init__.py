"""plans of talkmine."""
