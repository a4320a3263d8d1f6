"""Range, level, window, keyed and set operators over roll-ups."""
