"""Readers and writers: source trees, Git, artifacts, activity logs."""
