"""Snapshots, operation logs and the collection catalog on any Hadoop file system."""
