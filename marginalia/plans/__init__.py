"""Whole plans: building the index tables, answering batches of questions, and the query catalogue."""
