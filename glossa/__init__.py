"""Glossa: lexical similarity analytics as Spark DataFrame and Column operations."""
