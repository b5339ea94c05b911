"""Multi-step physical strategies built from DataFrame operations."""
