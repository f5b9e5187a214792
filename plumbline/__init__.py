"""plumbline: structural code-health analytics and relational building blocks on PySpark."""

__version__ = "0.1.0"
