"""Streaming.

The reference has no streaming operators: no watermarks, windows over event
time, stateful operators or late data (SURVEY §1.1 and §2.15).  Every step is
a batch over an immutable snapshot, so nothing here is built; batch plans run
unchanged inside ``foreachBatch`` if a caller streams snapshots in.
"""
