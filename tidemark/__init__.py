"""Versioned key-value records as Spark tables: last-writer-wins state, range routing, replicas, access statistics."""
