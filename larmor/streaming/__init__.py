"""Time frames of shots that arrive as a stream."""
