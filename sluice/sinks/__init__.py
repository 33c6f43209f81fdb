"""Terminals: actions, alerts, refills, dumps and extracts."""
