"""Where graphs come from: tables, files of source text, a generator."""
