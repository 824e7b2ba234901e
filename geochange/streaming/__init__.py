"""Incremental work: new scenes, pairs and alerts as they come."""
