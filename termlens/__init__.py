"""Skill-gap analytics and corpus preparation on Spark."""
