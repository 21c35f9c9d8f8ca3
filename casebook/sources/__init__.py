"""Where events come from: payload parsers, file readers and table writers."""
