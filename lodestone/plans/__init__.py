"""Whole plans: graph build and batched question answering."""
