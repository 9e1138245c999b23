"""The line scan and the gap clustering over streams."""
