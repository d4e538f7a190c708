"""The named queries; importing any of them registers all."""

import importlib

for _name in ("corpus", "answers", "evaluation", "audits", "streams", "sources", "models"):
    importlib.import_module(f"sieveline.plans.{_name}")
