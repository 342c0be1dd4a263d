"""What several test files use; not in conftest.py, since each folder has one of that name."""

SF = "/root/testdata/sf0.001"


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
