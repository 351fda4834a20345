"""The row-level operators on streaming input. Nothing here keeps state."""
