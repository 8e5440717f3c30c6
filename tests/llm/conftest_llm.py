"""Helpers of the tests in this folder."""

import os
import re

import pytest

SF = os.environ.get("HAZEFLOW_TEST_SF", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables not present")


def words(text):
    """Runs without ASCII white space."""
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
