"""Column-level building blocks (each returns a ``Column``)."""
