"""Registered queries: each module adds Spark plans and their oracle SQL."""

from corrobora.plans.registry import oracles, plans

__all__ = ["oracles", "plans"]
