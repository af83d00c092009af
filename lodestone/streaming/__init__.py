"""Structured Streaming: event windows, request logs, threads and the job queue."""
