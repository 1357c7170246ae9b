"""Task-log analytics as Spark DataFrame operators."""

from worklens.config import DEFAULT, Vocabulary, portuguese_vocabulary

__all__ = ["DEFAULT", "Vocabulary", "portuguese_vocabulary"]
