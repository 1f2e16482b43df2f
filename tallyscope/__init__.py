"""Tallyscope: a transfer-risk analytics engine expressed as lazy Spark plans."""
