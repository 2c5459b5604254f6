import pytest

pytest.importorskip("medlattice.llm")
