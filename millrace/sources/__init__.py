"""Readers and stores: DDL, JSON lines, the failure corpus."""
