"""Analytics over logs of AI-agent evaluations, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
