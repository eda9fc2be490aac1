"""Column functions shared by the models."""

from tidemark.functions.columns import *  # noqa: F403
