"""Streams of events: an extension, for which batch results are the measure."""
