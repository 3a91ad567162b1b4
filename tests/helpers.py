DATA = "/root/testdata/sf0.001"


def rows_of(frame) -> list[str]:
    """Rows of a pandas frame, columns by name, in a form to compare."""
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object)
    return sorted(map(repr, plain.where(plain.notna(), None).values.tolist()))
