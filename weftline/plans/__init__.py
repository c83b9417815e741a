"""Flows: batch copies, graphs of nodes, run parameters, and sample domain reads."""
