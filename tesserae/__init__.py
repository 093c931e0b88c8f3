"""Tile, telemetry and corpus analytics expressed as Spark DataFrame plans."""
