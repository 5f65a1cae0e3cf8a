"""Declarative plans that become DataFrame queries: cleaning, dashboards, questions."""
