"""What the tests of this folder share."""

from importlib.util import module_from_spec, spec_from_file_location
from pathlib import Path

DATA = "/root/testdata"
_spec = spec_from_file_location("llm_conftest", Path(__file__).with_name("conftest.py"))
_own = module_from_spec(_spec)
_spec.loader.exec_module(_own)
SCHEMA, row, prose, by_id = _own.SCHEMA, _own.row, _own.prose, _own.by_id
