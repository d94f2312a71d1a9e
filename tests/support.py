"""What tests share."""

DATA = "/root/testdata/sf0.001"


def same(got, want) -> None:
    """Two pandas frames hold the same rows, in any order of rows and columns."""
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = (sorted(map(repr, f[cols].astype(object).where(f[cols].notna(), None).itertuples(index=False, name=None))) for f in (got, want))
    assert a == b
