"""Readers and writers: activities, partitioned tables, edges, counters, registry."""
