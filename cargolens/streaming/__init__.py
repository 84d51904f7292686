"""Structured Streaming: order figures kept up to date from a stream of events (``order_figures``)."""
