"""Training-data operators over text corpora; nothing else in the package imports this."""
