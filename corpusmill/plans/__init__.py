"""Importing this package fills the registry."""

from . import answers, build, corpus, fielded, judging, more, patches, predictors, registry, timelines, vectors

__all__ = ["answers", "build", "corpus", "fielded", "judging", "more", "patches", "predictors", "registry", "timelines", "vectors"]
