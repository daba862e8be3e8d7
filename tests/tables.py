"""Small helpers around tables, for tests to import by name."""


def as_dicts(df):
    return [row.asDict(recursive=True) for row in df.collect()]
