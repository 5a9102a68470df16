"""postern: mail-transport security posture analytics as PySpark DataFrame jobs."""

__all__ = ["dims", "schemas", "session"]
