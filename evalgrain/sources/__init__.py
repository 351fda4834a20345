"""Readers and writers for run logs, case files, gradings, skills and sessions."""
