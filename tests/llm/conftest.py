import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def rows_of():
    """Sorted rows of a result as tuples of the named columns."""

    def rows(df, *columns):
        return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)

    return rows
