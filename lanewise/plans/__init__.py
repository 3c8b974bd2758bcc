"""Registered queries over the driver's tables and small literal inputs, with their SQL."""
