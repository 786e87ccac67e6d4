"""Federated-search analytics and data preparation on Spark."""
