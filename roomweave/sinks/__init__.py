"""Files of one piece, written by many tasks."""
