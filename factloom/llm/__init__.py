"""Training-data operators: scoring, scanning, filtering, mixing, joining and encoding of document tables."""
