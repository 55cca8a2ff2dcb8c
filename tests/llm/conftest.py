import pytest

# The tests beside this folder import SMALL from the module "conftest", which may be this one.
SMALL = "/root/testdata/sf0.001"


@pytest.fixture()
def docs_of(spark):
    """Documents from (doc_id, text) pairs."""
    def make(rows, extra=None):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        return spark.createDataFrame(
            [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], schema)
    return make


def certain_collision(n=1024, signs="ab"):
    """Two different words that every polynomial hash modulo 2**64 gives the same value."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(signs[b] for b in bits), "".join(signs[1 - b] for b in bits)
