"""Detection-and-crop analytics as Spark DataFrame plans, with training-corpus operators in ``framewright.llm``."""

__version__ = "0.1.0"
