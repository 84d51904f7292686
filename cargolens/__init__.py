"""Delivery-performance analytics for marketplace order data, on Spark."""

__version__ = "0.1.0"
