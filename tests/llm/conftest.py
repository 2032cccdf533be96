import pytest

pytest.importorskip("vacantia.llm")
