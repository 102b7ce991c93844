"""Readers, sniffers, connectors and sinks for files of many kinds."""
