"""DataFrame operators for caption, transcript and hypothesis streams at scale."""
