"""The texts of conftest, for comparison by brute force."""

import importlib.util
from pathlib import Path

_spec = importlib.util.spec_from_file_location("llm_conftest", Path(__file__).with_name("conftest.py"))
_module = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_module)
TEXTS, BASE, LONG = _module.TEXTS, _module.BASE, _module.LONG
