"""Scalar building blocks: functions from Column to Column."""
