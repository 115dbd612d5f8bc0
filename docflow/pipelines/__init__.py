"""Pipelines that come with the package: every module here registers itself when it is imported."""

from ..plans.registry import Registry

#: What ``REGISTRY.discover(__name__)`` fills; the first module in order of names is the default.
REGISTRY = Registry()
