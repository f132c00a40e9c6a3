"""Operators: functions from one DataFrame to another."""
