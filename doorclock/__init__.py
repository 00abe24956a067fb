"""Delivery-time analytics expressed as Spark DataFrame jobs."""
