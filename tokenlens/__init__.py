"""tokenlens: token-corpus search and surprisal analytics expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
